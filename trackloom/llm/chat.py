"""Chat formatting with offset-aligned loss masks.

A conversation becomes one string: each turn is `<|turn|>` role `<|text|>` text `<|end|>`. Inside roles and texts every
`<` that backslashes (none or more) and then `|` follow gets one more backslash, which makes control strings impossible
there and is undone by taking it away. The whole string is encoded once, with offsets; the three control strings are
special tokens, so no token crosses a turn's border. Sorted spans of assistant texts are intersected with the sorted
token spans by binary search, which gives the loss mask.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import small_batches

TOKENIZER = "byte_bpe_50k.json"
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROL = re.compile(r"<(\\*)\|")
ESCAPED = re.compile(r"<\\(\\*)\|")

_tokenizers: dict[str, object] = {}


def escape(text: str) -> str:
    return CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]], trained: str = "assistant") -> tuple[str, np.ndarray]:
    """The formatted conversation and the sorted (start, end) spans of the trained role's texts."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role == trained and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), np.array(spans, np.int64).reshape(-1, 2)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation, unescaped."""
    turns = []
    for part in formatted.split(TURN)[1:]:
        role, _, text = part.removesuffix(END).partition(TEXT)
        turns.append((unescape(role), unescape(text)))
    return turns


def _tokenizer(name: str):
    if name not in _tokenizers:
        import public_tokenizers
        from tokenizers import Tokenizer, processors

        t = Tokenizer.from_file(name if "/" in name else public_tokenizers.path(name))
        t.post_processor = processors.ByteLevel(trim_offsets=False)  # offsets with their blanks: tokens tile the text
        t.add_special_tokens([TURN, TEXT, END])
        _tokenizers[name] = t
    return _tokenizers[name]


def loss_mask(spans: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True for tokens that lie in one of the sorted disjoint spans."""
    if not len(spans):
        return np.zeros(len(starts), bool)
    own = np.searchsorted(spans[:, 0], starts, side="right") - 1
    return (own >= 0) & (ends <= spans[np.maximum(own, 0), 1]) & (starts < spans[np.maximum(own, 0), 1])


def format_conversations(rows: DataFrame, tokenizer: str = TOKENIZER, trained: str = "assistant", conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: conv_id, formatted, token_ids, token_starts, token_ends, loss_mask (arrays by token; offsets in code points).

    Turns go by their number, ties by role, then text; repeated rows are repeated turns. A null role or text is empty; a
    null turn comes first. Rows with a null conv_id make one conversation of their own. An empty table gives an empty
    result. A conversation is one training example and is formatted whole, in one task. Other columns are not read.
    """
    small_batches(rows.sparkSession)
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    whole = rows.groupBy(F.col(conv_id).cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(tokenizer)
        for b in batches:
            made = [render([(x["role"], x["text"]) for x in turns], trained) for turns in b.column("turns").to_pylist()]
            ids, starts, ends, masks = [], [], [], []
            for (formatted, spans), e in zip(made, (t.encode(f, add_special_tokens=False) for f, _ in made), strict=True):
                off = np.array(e.offsets, np.int32).reshape(-1, 2)
                assert len(formatted) == (off[-1, 1] if len(off) else 0)
                ids.append(e.ids)
                starts.append(off[:, 0])
                ends.append(off[:, 1])
                masks.append(loss_mask(spans, off[:, 0], off[:, 1]))
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array([f for f, _ in made], pa.string()), pa.array(ids, pa.list_(pa.int32())), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.bool_()))], ["conv_id", "formatted", "token_ids", "token_starts", "token_ends", "loss_mask"])

    return whole.mapInArrow(run, "conv_id long, formatted string, token_ids array<int>, token_starts array<int>, token_ends array<int>, loss_mask array<boolean>")


def masked_text(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> str:
    """What the masked tokens cover, unescaped; runs of touching tokens are unescaped as one text each."""
    s, e = starts[mask], ends[mask]
    if not len(s):
        return ""
    new = np.concatenate([[True], s[1:] > np.maximum.accumulate(e)[:-1]])
    first = np.flatnonzero(new)
    return "".join(unescape(formatted[a:b]) for a, b in zip(s[first].tolist(), np.maximum.reduceat(e, first).tolist(), strict=True))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all from the formatted output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                turns = parse(r["formatted"])
                loss = masked_text(r["formatted"], np.array(r["token_starts"], np.int64), np.array(r["token_ends"], np.int64), np.array(r["loss_mask"], bool))
                said = "".join(f"{role}\n{text}\n" for role, text in turns)
                rows.append((r["conv_id"], len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(r["formatted"])))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
