"""Operator 11 against plain loops, all edit sequences of small conversations, and SQL."""

from __future__ import annotations

from itertools import product

import pytest

from tests.llm import brute_dialogue
from tidemark.llm import dialogue, queries

SCHEMA = "conv_id long, turn long, role string, text string, at long, seq long, identity string, copies string, kind int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, 8, "x", "y", 9) for r in rows], SCHEMA).repartition(3)


def result(df):
    return {r["conv_id"]: tuple(r)[1:] for r in dialogue.repair_report(df).collect()}


def all_audits(codes: str):
    """Cost and audit of every edit sequence with at most two insertions in a row, checked against the grammar alone."""
    best = None
    for gaps in product(range(3), repeat=len(codes) + 1):
        for edits in product("DKR", repeat=len(codes)):
            state, cost, audit, legal = "", 0, "", True
            for i in range(len(codes) + 1):
                for _ in range(gaps[i]):
                    state, cost, audit = ("a" if state == "u" else "u"), cost + 3, audit + "I"
                if i == len(codes):
                    break
                fault, initial = divmod(ord(codes[i]) - 97, 4)
                audit += edits[i]
                if edits[i] == "D":
                    cost += 4
                    continue
                cost += 3 * (fault == 3)
                wanted = {"": "su", "s": "u", "u": "a", "a": "u", "o": "u"}[state]  # o: illegal already
                role = "suao"[initial] if edits[i] == "K" else wanted[-1]
                legal &= fault in (0, 3) and role in wanted
                cost += 3 * (edits[i] == "R")
                state = role
            if legal and state in ("", "a") and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


@pytest.mark.parametrize("length", [0, 1, 2])
def test_audits_are_the_least_of_all_edit_sequences(length):
    for codes in map("".join, product("abcdeghmnop", repeat=length)):
        steps, cost = dialogue.solve(codes)
        assert (cost, dialogue.audit_of(steps)) == all_audits(codes), codes


def test_four_rows_with_every_start():
    for codes in ("cccc", "bnao", "dbbc", "accd", "mmnn", "oadb", "fbbc"):
        steps, cost = dialogue.solve(codes)
        assert (cost, dialogue.audit_of(steps)) == all_audits(codes), codes


def test_whole_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.op11_conversation_repair(spark, sf_dir).collect()}
    assert got == brute_dialogue.report([tuple(r) for r in rows])


ODD = [
    (1, None, None, None), (1, None, None, None), (1, 0, "user", "What?"), (1, 2, "assistant", "Yes."), (1, 2, "assistant", "No"),
    (None, 3, "user", "hello \t\n"), (None, 4, "assistant", "Good."), (None, None, "", "x."),
    (2, 0, "tool", "Done."), (2, 1, "Über", "é…"), (2, 7, "system", "Be kind!"), (3, 5, "user", ""), (4, 0, None, "a."), (4, 1, "user", None),
    (5, 0, "user", "tail . "), (6, 0, "assistant", "Same."), (6, 1, "assistant", "Same."), (6, 1, "assistant", "Same."),
    (7, 0, "user", "long words. " * 50_000), (7, 1, "assistant", " " * 300_000 + "end."),
]


def test_nulls_ties_repeats_and_long_texts(spark):
    assert result(frame(spark, ODD)) == brute_dialogue.report(ODD)


def test_empty_table(spark):
    assert result(spark.createDataFrame([], SCHEMA)) == {}


@pytest.mark.parametrize("segment", [1, 2, 64])
def test_long_conversations_in_segments(spark, monkeypatch, segment):
    monkeypatch.setattr(dialogue, "SEGMENT", segment)
    roles, texts = ["user", "assistant", "system", "user", "tool"], ["Fine.", "", "cut", "Same!", "So?", "x."]
    rows = [(9, i, roles[i * 7 % 5], texts[i * 5 % 6] + str(i % 11) * (i % 3)) for i in range(600)]
    rows += [(None, i // 2, roles[i * 3 % 5], f"{i % 40}.") for i in range(300)] + ODD[:-2]
    assert result(frame(spark, rows)) == brute_dialogue.report(rows)


def test_repaired_rows_follow_the_grammar(spark):
    rows = [(k, t, ["user", "assistant", "system"][(k + t * t) % 3], f"Turn {t}.") for k in range(30) for t in range(k % 7)]
    made = dialogue.repair(dialogue.damage(frame(spark, rows))).rows.orderBy("conv_id", "at", "seq").collect()
    by_conv: dict = {}
    for r in made:
        by_conv[r["conv_id"]] = by_conv.get(r["conv_id"], "") + r["role"][0]
    for initials in by_conv.values():
        assert initials.removeprefix("s") == "ua" * (len(initials.removeprefix("s")) // 2) and initials != "s"
