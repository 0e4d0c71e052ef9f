import re

import pytest

from millrace.llm.license_rules import BASE, Rule, rules
from millrace.llm.license_scan import license_scan
from tests.llm.helpers import SF, by_id, docs

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(low)
    found = [(i, label) for p, label in BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def test_base_equals_brute_force(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    texts += [None, "", " \n", "MIT License mit-license MIT\n\nLICENSE", "CC BY cc by-NC 4.0 accby", "GNU General Public License, version 3.", "the apache license", "K licenſe K mit licenKe", "mİt license", "cc  by" * 3000, "mit license " * 500]
    got = by_id(license_scan(docs(spark, texts)))
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(t), t
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1


def test_labels_and_suppression(spark):
    texts = ["Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "GNU Lesser General Public License v2.1 applies", "plain words", "Redistribution and use in source and binary forms"]
    got = by_id(license_scan(docs(spark, texts)))
    assert [got[i]["labels"] for i in range(5)] == ["apache,apache-2.0", "cc-by,cc-by-nc-4.0", "lgpl-2.1", "", "bsd"]
    assert got[3]["score"] == 0 and got[0]["score"] == 1


def brute_labels(text, table):
    """Every rule at every word; each detection against all others."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, found = WORDS.findall(low), []
    for i in range(len(words)):
        rest = " ".join(words[i : i + 60])
        for rank, r in enumerate(table):
            if rest.startswith(r.regex[:2]) and (m := re.match(f"(?:{r.regex})(?= |$)", rest)):
                found.append((i, i + len(m[0].split(" ")), r.priority, rank, r.label, r.weight))

    def suppressed(d, o):
        same, covers, inside = d[:2] == o[:2], o[0] <= d[0] and o[1] >= d[1], o[0] >= d[0] and o[1] <= d[1]
        if same:
            return (o[2], o[3]) < (d[2], d[3])
        return covers and o[2] <= d[2] or not covers and not inside and o[0] < d[1] and o[1] > d[0] and o[2] < d[2]

    stay = [d for d in found if not any(suppressed(d, o) for o in found)]
    base = {d[4] for d in found if BASE.get(table[d[3]].regex) == d[4]}
    return ",".join(sorted({d[4] for d in stay} | base)), max((d[5] for d in stay), default=0.0)


def sample_of(regex):
    """A text that a rule's regex matches, with its optional parts left out."""
    made = re.sub(r"\([^()]*\)\?|[a-z]\?| \?", "", regex.replace("( [^ ]+)?", "").replace("(ative)?", ""))
    made = made.replace("[^ ]+", "acme").replace("[cs]", "c").replace("[0-9]", "7")
    return re.sub(r"\(([^|()]*)\|?[^()]*\)", r"\1", made)


def test_every_rule_passes_the_gate_and_equals_brute_force(spark):
    table = rules()
    assert len(table) > 300 and len({r.regex for r in table}) == len(table)
    samples = [sample_of(r.regex) for r in table]
    for r, sample in zip(table, samples, strict=True):
        assert re.fullmatch(r.regex, sample), (r, sample)
        assert len(sample.split()) <= r.words
    texts = [f"{t.title()}, {u}" for t, u in zip(samples, samples[1:] + samples[:1], strict=True)] + samples + ["; ".join(samples)] + ["mit license gnu gpl v2 " * 400]
    got = by_id(license_scan(docs(spark, texts)))
    for i, t in enumerate(texts):
        labels, score = brute_labels(t, table)
        assert (got[i]["labels"], got[i]["score"]) == (labels, score), t[:200]


def test_a_table_of_ones_own(spark):
    table = [Rule("acmecorp terms of use", "acme", 1, 0.9), Rule("acmecorp", "acme-name", 2, 0.2), Rule("begin( [^ ]+){0,30} end", "span", 3, 0.5, longest=32)]
    got = by_id(license_scan(docs(spark, ["the AcmeCorp terms of use", "acmecorp", "mit license", "begin " + "x " * 30 + "end", "begin " + "x " * 31 + "end"]), table=table))
    assert [got[i]["labels"] for i in range(5)] == ["acme", "acme-name", "", "span", ""]
    assert got[2]["n_base"] == 0 and license_scan(docs(spark, ["a"]), table=[]).count() == 1
    for bad in ("(a|b) c", "a( b)* c"):
        with pytest.raises(ValueError):
            license_scan(docs(spark, ["a"]), table=[Rule(bad, "x", 1, 1.0)])


def test_ties_repeats_and_null_ids(spark):
    table = [Rule("one two", "first", 1, 0.5), Rule("one( two)", "second", 1, 0.6), Rule("two three", "weaker", 2, 0.7)]
    d = docs(spark, ["one two three"] * 3).selectExpr("if(doc_id = 2, null, 1) as doc_id", "text")
    got = [(r["doc_id"], r["labels"], r["score"]) for r in license_scan(d, table=table).collect()]
    assert sorted(got, key=str) == [(1, "first", 0.5), (1, "first", 0.5), (None, "first", 0.5)]


def test_empty_table_and_clashing_columns(spark):
    assert license_scan(docs(spark, [])).count() == 0
    odd = docs(spark, ["mit license"]).selectExpr("*", "1 as labels", "2 as score", "'x' as r")
    assert by_id(license_scan(odd))[0]["labels"] == "mit"
