"""Every known sentence and every rule of the license scan, however it is laid out."""

import textwrap

from pyspark.sql import functions as F

from trackloom.llm import licenses

LAYOUTS = {
    "line": lambda s: f"Header line\n{s}.\nmore text",
    "within": lambda s: f"Some text. {s}. And more.",
    "wrapped": lambda s: "Header line\n\n" + "\n".join(textwrap.wrap(s + ".", 40)) + "\n\nmore text",
    "comment": lambda s: "\n".join(f" *  {x}" for x in textwrap.wrap(s, 50)),
}


def test_every_sentence_and_rule(spark):
    s = licenses.SENTENCES
    one = [(lay, name, f(s[name])) for lay, f in LAYOUTS.items() for name in s]
    ways = [(lay, licence, way, "\n".join(f(s[x]) for x in way)) for lay, f in LAYOUTS.items() for licence, of in licenses.RULES.items() for way in of]
    texts = [t for *_, t in one] + [t for *_, t in ways]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [(lay, name) for i, (lay, name, _) in enumerate(one) if i not in got or got[i].sentence_ids != name] == []
    assert [(lay, licence) for i, (lay, licence, way, _) in enumerate(ways, len(one)) if i not in got or got[i].licenses != licence or got[i].sentence_ids != ",".join(way)] == []


def test_far_apart_and_twice(spark):
    s = licenses.SENTENCES
    bsd = [s[x] for x in ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")]
    texts = [
        "Released under" + " " * 30000 + "the MIT License.",
        ".\n" * 50000 + "Licensed under" + " \n" * 50000 + "CC BY 4.0",
        ". ".join(bsd) + ".",
        ". ".join(bsd + bsd[:3]) + ".",
        ". ".join(bsd[:3] + bsd) + ".",
        "Released under the MIT License of old",
    ]
    got = {r.doc_id: r.licenses for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("sentence_ids", F.lit(1))).collect()}
    assert got == {0: "MIT", 1: "CC-BY-4.0", 2: "BSD-3-Clause", 3: "BSD-2-Clause,BSD-3-Clause", 4: "BSD-2-Clause,BSD-3-Clause"}


def test_own_sentences(spark):
    own = {"a": "Zebras may: graze. Here " + "very " * 600 + "long", "b": "Quux"}
    rows = [(1, "x\n" + own["a"].replace("graze. ", "graze.\n") + "."), (2, "so. quux. so"), (3, "zebras may graze"), (4, "quux it")]
    got = {r.doc_id: (r.sentence_ids, r.licenses) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), own, {"A": [["a"]], "B": [["b"]]}).collect()}
    assert got == {1: ("a", "A"), 2: ("b", "B")}
