"""License scan by ordered signature rules (DataFrame functions only, no shuffle).

A keyword prefilter, made from the rules' openings, lets through the texts that can match at all. In those, every rule is tried at
each word that is its keyword, on as many words as the keyword's rules can match, so a text's cost is linear in its words. A detection is suppressed where
another one covers its words and is at least as strong (or covers exactly them and comes first in the order), or overlaps
them and is stronger. What remains gives the labels; the contract's base phrases are always kept.

Edge cases: null text counts as empty (0 words, empty labels, score 0); texts of any length are scanned whole; phrases
that overlap are all counted as base places. Rows are judged one by one, so repeated rows give equal rows, and an empty
table an empty result. A null doc_id passes through. Other columns of the input are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.license_rules import BASE, WORD, Rule, gate, rules
from millrace.llm.store import let
from millrace.llm.text import ascii_lower, text_or_empty

_DETECTION = "array<struct<start:int,stop:int,priority:int,rank:int,label:string,weight:double>>"


def words_of(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"{WORD}+"), F.lit(0)), ascii_lower)


def _by_keyword(table: list[Rule]) -> dict[str, dict]:
    by: dict[str, dict] = {}
    for rank, r in enumerate(table):
        of = by.setdefault(r.opening[0], {"longest": 0, "rules": []})
        of["longest"] = max(of["longest"], r.words)
        of["rules"].append({"rank": rank, "regex": f"^(?:{r.regex})(?= |$)", "label": r.label, "priority": r.priority, "weight": r.weight})
    return by


def detections(words: Column, table: list[Rule]) -> Column:
    """All matches of all rules in an array of words, in order of their first word (counted from 0)."""
    by = _by_keyword(table)
    # One literal for the whole table keeps the plan small.
    kind = "map<string,struct<longest:int,rules:array<struct<rank:int,regex:string,label:string,priority:int,weight:double>>>>"
    keywords = F.from_json(F.lit(json.dumps(by)), kind)

    def at(i: Column) -> Column:
        def tried(of: Column) -> Column:
            def in_window(window: Column) -> Column:
                def match(r: Column) -> Column:
                    stop = i + F.size(F.split(F.regexp_substr(window, r["regex"]), " "))
                    return F.struct(i.alias("start"), stop.alias("stop"), r["priority"].alias("priority"), r["rank"].alias("rank"), r["label"].alias("label"), r["weight"].alias("weight"))

                return F.transform(F.filter(of["rules"], lambda r: F.rlike(window, r["regex"])), match)

            return let(F.array_join(F.slice(words, i + 1, of["longest"]), " "), in_window)

        return let(F.element_at(keywords, F.get(words, i)), tried)

    known = F.lit(sorted(by))
    starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.array_contains(known, F.get(words, i)))
    return F.when(F.size(words) > 0, F.flatten(F.transform(starts, at))).otherwise(F.array()).cast(_DETECTION)


def reach(table: list[Rule]) -> int:
    """How many places apart, in the order of their first words, two overlapping detections can be: they begin less than the
    longest match apart, and at a word no more rules match than share a keyword."""
    by = _by_keyword(table).values()
    return max((of["longest"] for of in by), default=0) * max((len(of["rules"]) for of in by), default=0)


def unsuppressed(found: Column, near: int) -> Column:
    """Detections that no other one suppresses. ``near``: the ``reach`` of the rules, past which none overlaps."""

    def stays(d: Column, j: Column) -> Column:
        def suppresses(o: Column) -> Column:
            covers = (o["start"] <= d["start"]) & (o["stop"] >= d["stop"])
            same = (o["start"] == d["start"]) & (o["stop"] == d["stop"])
            order = (o["priority"] < d["priority"]) | ((o["priority"] == d["priority"]) & (o["rank"] < d["rank"]))
            overlaps = (o["start"] < d["stop"]) & (o["stop"] > d["start"])
            return (covers & F.when(same, order).otherwise(o["priority"] <= d["priority"])) | (overlaps & ~same & ~((o["start"] >= d["start"]) & (o["stop"] <= d["stop"])) & (o["priority"] < d["priority"]))

        return ~F.exists(F.slice(found, F.greatest(j - near, F.lit(0)) + 1, 2 * near + 1), suppresses)

    return F.filter(found, stays)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: list[Rule] | None = None) -> DataFrame:
    """One row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections (the
    unsuppressed ones, as word spans with label and weight)."""
    table = rules() if table is None else table
    opens, near = gate(table), reach(table)
    base_ranks = F.lit([i for i, r in enumerate(table) if BASE.get(r.regex) == r.label]).cast("array<int>")

    def judged(words: Column) -> Column:
        def of(found: Column) -> Column:
            own = F.filter(found, lambda d: F.array_contains(base_ranks, d["rank"]))
            return F.struct(F.size(words).cast("bigint").alias("n_words"), own.alias("base"), unsuppressed(found, near).alias("found"))

        return let(detections(words, table), of)

    text = text_or_empty(F.col(text_col))
    nothing = F.array().cast(_DETECTION)
    plain = F.struct(F.regexp_count(text, F.lit(f"{WORD}+")).cast("bigint").alias("n_words"), nothing.alias("base"), nothing.alias("found"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.when(text.rlike(opens), let(words_of(text), judged)).otherwise(plain).alias("r"))
    label = lambda c: F.transform(c, lambda d: d["label"])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    first, last = F.array_min(F.transform("r.base", lambda d: d["start"])), F.array_max(F.transform("r.base", lambda d: d["start"]))
    return rows.select(
        "doc_id", "r.n_words", F.size("r.base").cast("bigint").alias("n_base"), first.cast("bigint").alias("first_word"), last.cast("bigint").alias("last_word"),
        joined(label(F.col("r.base"))).alias("base_labels"), joined(F.concat(label(F.col("r.base")), label(F.col("r.found")))).alias("labels"),
        F.coalesce(F.array_max(F.transform("r.found", lambda d: d["weight"])), F.lit(0.0)).alias("score"), F.col("r.found").alias("detections"),
    )
