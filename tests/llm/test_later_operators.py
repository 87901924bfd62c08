"""Conversation repair, quality rules and tokenizer alignment: brute force, hand-made cases, hard rows."""

import hashlib
import random
from collections import Counter
from itertools import product

import pytest
import sentencepiece
from meterline.llm import alignment, conversations, quality
from meterline.llm.queries import tokenizer_files
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .test_operators import HARD, frame

SAID = "conv_id long, turn long, role string, text string, copies int"
NOTHING = hashlib.sha256(b"").hexdigest()


# 11: conversations


def edits_by_hand(codes, most=4):
    """Least (cost, edits) by trying every edit of every row and up to ``most`` inserts."""
    best = None
    gaps = list(product(range(3), repeat=len(codes) + 1))
    for own in product("DKR", repeat=len(codes)):
        for inserts in (g for g in gaps if sum(g) <= most):
            out, roles, cost = "", "", 5 * sum(inserts)
            spots = [(i, "I") for i in range(len(codes) + 1) for _ in range(inserts[i])] + [(i + 0.5, e) for i, e in enumerate(own)]
            for i, e in sorted(spots):
                out += e
                if e == "D":
                    cost += 2
                    continue
                initial, fault = ("?", 0) if e == "I" else divmod(codes[int(i)], 3)
                if e == "K":
                    initial = "sua?"[initial]
                cost += {"I": 0, "K": 0, "R": 1}[e] + {0: 0, 1: 10**6, 2: 5}[fault]
                roles += initial if e == "K" else "*"
            fits = [r for r in ("", *("s" * s + "ua" * n for s in (0, 1) for n in range(1, 6))) if len(r) == len(roles)]
            ok = any(all(a == b or a == "*" and b != "s" for a, b in zip(roles, r)) for r in fits)
            if ok and (best is None or (cost, out) < best):
                best = cost, out
    return best


def test_edits_equal_brute_force():
    rng = random.Random(4)
    for n in (0, 1, 2, 3, 3, 4, 4, 4):
        for _ in range(3):
            codes = bytes(rng.randrange(12) for _ in range(n))
            found = conversations.Edits(codes)
            assert (found.cost, "".join(found)) == edits_by_hand(codes), list(codes)


def test_checkpoints_do_not_change_the_edits():
    rng = random.Random(5)
    codes = bytes(rng.randrange(12) for _ in range(1_000))
    want = list(conversations.Edits(codes, 1_000_000))
    for block in (1, 7, 10, 1_000, None):
        found = conversations.Edits(codes, block)
        assert list(found) == want and len(found.checkpoints) <= 1_000 // found.block + 1


def repaired(spark, rows, schema=SAID):
    return {r.conv_id: r for r in conversations.repair(spark.createDataFrame(rows, schema)).collect()}


def test_repair_by_cases(spark):
    rows = [
        (1, 0, "system", "Be brief.", 1), (1, 1, "user", "Hi.", 1), (1, 2, "assistant", "Hello.", 1),  # sound
        (2, 0, "user", "Hi.", 1), (2, 1, "user", "There?", 1), (2, 2, "assistant", "Yes.", 1),
        (3, 5, "user", "Hi.", 2), (3, 7, "assistant", " \n", 1), (3, 8, "assistant", "Yes.", 1),
        (4, 1, "user", "Dropped.", 0),
        (5, 0, "assistant", "Alone and cut", 1),
        (None, None, "user", "Late?", 1), (None, None, "tool", "Out.", 1), (None, 3, None, None, None),
    ]
    found = repaired(spark, rows)
    text = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert found[1][1:] == (0, 0, 0, 0, 0, 0, "KKK", text("system:Be brief.\nuser:Hi.\nassistant:Hello."))
    assert found[2][1:] == (0, 0, 0, 0, 1, 2, "DKK", text("user:There?\nassistant:Yes."))
    assert found[3][1:] == (1, 1, 1, 0, 2, 4, "KDDK", text("user:Hi.\nassistant:Yes."))
    assert found[4][1:] == (0, 0, 0, 0, 0, 0, "", NOTHING)
    assert found[5][1:] == (0, 0, 0, 1, 0, 2, "D", NOTHING)
    # Null turns come first, ordered by role; the tool's row becomes the user's.
    assert found[None][1:] == (0, 1, 0, 0, 2, 4, "RRD", text("user:Out.\nassistant:Late?"))


def test_a_conversation_of_many_equal_rows(spark):
    rows = [(7, i % 3, "user", "Same.", 1) for i in range(5_000)] + [(7, 9, "assistant", "Done.", 1)]
    found = repaired(spark, rows)[7]
    assert found.duplicate == 4_999 and found.audit == "K" + "D" * 4_999 + "K" and found.cost == 2 * 4_999


def test_damage_and_clashing_names(spark):
    rows = [(i, t, "user" if t % 2 else "assistant", f"Text {t}. Yes!", "x") for i in range(60) for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies string").withColumn("phase", F.lit("clash")).withColumn("fault", F.lit(1))
    hurt = conversations.damage(df).collect()
    assert {r.copies for r in hurt} == {0, 1, 2} and any(r.text == "" for r in hurt) and any(r.text == f"Text {r.turn} Yes" for r in hurt)
    assert conversations.repair(conversations.damage(df)).count() == 60
    assert conversations.repair(conversations.damage(df.limit(0))).count() == 0


# 12: quality rules


def clean(spark, texts, **rules):
    df = frame(spark, list(enumerate(texts))).withColumn("n_words", F.lit("clash")).withColumn("kept", F.lit("clash"))
    return [r for _, r in sorted((r.doc_id, r) for r in quality.clean_lines(df, **rules).collect())]


def test_rules_for_lines(spark):
    prose = " ".join(f"Word{i} and more{i} words{i} in a line{i}." for i in range(12))
    bad = ["Home | News | About | Contact.", "Read more.", "This site uses cookies.", "no end of a sentence", "BUY!! NOW!! GOOD!!", "cheap$$$ pills%%% here."]
    good = ["He said: ‘Go!’", "Les.", "(See below.)", "A cut paragraph. It stops in the", "He read more than most.", ""]
    for line in bad:
        r = clean(spark, [f"{prose}\n{line}\n{prose}"])[0]
        assert (r.lost_lines, r.lost_words, r.text) == (1, len(line.split()), f"{prose}\n{prose}"), line
    for line in good:
        r = clean(spark, [f"{prose}\n{line}\n"])[0]
        assert r.lost_lines == 0 and r.text == f"{prose}\n{line}\n" and r.kept, line


def test_documents_that_lose_too_much(spark):
    prose = " ".join(f"w{i}" for i in range(70)) + "."
    junk = lambda n: " ".join(f"j{i}" for i in range(n))
    found = clean(spark, [f"{prose}\n{junk(30)}", f"{prose}\n{junk(31)}", junk(60), "a b c d e. " * 40])
    assert [(r.kept, r.base_failed) for r in found] == [(True, False), (False, False), (False, False), (False, True)]
    assert clean(spark, [f"{prose}\n{junk(31)}"], most_lost=50)[0].kept


def test_measures_of_hard_rows(spark):
    found = clean(spark, [None, "", " \t\n", "a b c a b c\nx\nx\n", "é#  ü|\x0bz", "word " * 50_000])
    assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found] == [
        (0, 0, 0, 0, 0), (0, 0, 0, 0, 0), (0, 0, 0, 0, 0), (8, 8, 0, 1, 6), (3, 5, 2, 0, 0), (50_000, 200_000, 0, 0, 50_000),
    ]
    assert [r.text for r in found][:3] == [None, "", " \t\n"] and not any(r.kept for r in found)
    assert quality.clean_lines(frame(spark, [])).count() == 0 and quality.clean_lines(frame(spark, HARD)).count() == len(HARD)


# 13: alignment

A_FILE, B_FILE = tokenizer_files()
HARD_TEXTS = [
    None, "", " ", "  two  spaces ", "line\n next\r\n\tx", "▁ stands for a space", "a▁ b", "nul\x00 é ﬁ 日本 🙂🙂 Ωmega", "<s> <unk> </s> <|endoftext|> <0x41>",
    "x  y  z​ w", "don't we'll I'm", "2024-01-02  ->  #1", "Ünïcödé " * 300, "trailing \n\n  ", "﻿ bom", "a" * 5_000,
]


def align_by_hand(docs):
    """Whole texts, every pair of tokens compared."""
    a, b = Tokenizer.from_file(A_FILE), sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    a.encode_special_tokens = True
    spelt, n = {}, 0
    for x in range(256):
        plain = 33 <= x < 127 or 161 <= x < 173 or x >= 174
        spelt[chr(x) if plain else chr(256 + n)] = x
        n += not plain
    total, rows = Counter(), []
    for i, text in docs:
        if not text:
            rows.append((i, [], [], []))
            continue
        raw, x, y = (" " + text).encode(), a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        xb = [bytes(spelt[c] for c in a.id_to_token(t)) for t in x]
        yb = [bytes([int(p[3:5], 16)]) if b.is_byte(t) else p.replace("▁", " ").encode() for t in y for p in [b.id_to_piece(t)]]
        if b"".join(xb) != raw or b"".join(yb) != raw:
            rows.append((i, [], [], []))
            continue
        ends = lambda parts: [sum(map(len, parts[: k + 1])) for k in range(len(parts))]
        xe, ye = ends(xb), ends(yb)
        links = [(t, u) for t, e, p in zip(x, xe, xb) for u, f, q in zip(y, ye, yb) if max(e - len(p), f - len(q)) < min(e, f)]
        groups, start = [], 0
        for stop in sorted(set(xe) & set(ye)):
            groups.append("|".join(",".join(str(t) for t, e in zip(ids, at) if start < e <= stop) for ids, at in ((x, xe), (y, ye))))
            start = stop
        total.update(links)
        rows.append((i, (len(x), len(y)), groups, links))
    highest: dict = {}
    for (_, u), m in total.items():
        highest[u] = max(highest.get(u, 0), m)
    out = []
    for i, n, groups, links in rows:
        best = sum(total[x] == highest[x[1]] for x in links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((i, *(n or (0, 0)), len(groups), len(links), best, sum(total[x] for x in links), digest))
    return sorted(out, key=str), total


@pytest.mark.parametrize("sent", [0, 5, 1 << 19])
def test_alignment_equals_brute_force(spark, sent):
    short = [t for t in HARD_TEXTS if t is None or len(t) < 1_000]
    texts = [*short, *short[3:], "the cat sat on the mat. " * 5, *["the dog sat, too"] * 40]
    docs = [(i if i % 7 else None, t) for i, t in enumerate(texts)]
    df = frame(spark, docs).withColumn("text_key", F.lit("clash")).withColumn("copies", F.lit("clash")).withColumn("n", F.lit(1))
    rows, pairs = alignment.align(df, A_FILE, B_FILE, sent)
    want, total = align_by_hand(docs)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r[c] for c in names) for r in rows.collect()), key=str) == want
    assert {(r.a_id, r.b_id): r.n for r in pairs.collect()} == total


def test_pieces_join_to_the_whole(spark):
    aligner = alignment.Aligner(A_FILE, B_FILE)
    assert aligner.cuts
    rng = random.Random(6)
    alphabet = [" ", "  ", "\n", "\t", " ", "　", "a", "The", "é", "日", ".", "'s", "12", "▁", "\x00", "🙂", "-"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 30))) for _ in range(3_000)]
    for t in [*texts, *filter(None, HARD_TEXTS)]:
        whole = aligner.align(" " + t, aligner.a.encode(" " + t, add_special_tokens=False).ids, aligner.b.encode(t))
        parts = aligner.text(t)
        assert (parts is None) == (whole is None), repr(t)
        if whole:
            assert ";".join(p.rendered for p in parts) == whole.rendered and b"".join(p.links for p in parts) == whole.links, repr(t)


def test_alignment_of_no_and_few_rows(spark):
    assert alignment.align(frame(spark, []), A_FILE, B_FILE)[0].count() == 0
    found = alignment.align(frame(spark, [(1, None), (None, None)]), A_FILE, B_FILE)[0].collect()
    assert [tuple(r[1:]) for r in found] == [(0, 0, 0, 0, 0, 0, "")] * 2
    assert alignment.align(frame(spark, HARD), A_FILE, B_FILE)[0].count() == len(HARD)
