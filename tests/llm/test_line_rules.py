"""Line rules: cases one by one, and whole tables by the query's SQL (tests/test_oracles.py)."""

import random
import re

from quiltframe.llm import line_rules as L

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLEAN = "\n".join(" ".join(f"{a}{b}{c}o" for a in "bdfgk" for b in "aei") + f" the {c}end." for c in "lmnpr")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    seen, places = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i:i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            places |= {i + k for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in L.SYMBOLS), len(lines) - len(set(lines)),
            len(places), len(words) < 50 or 100 * len(places) > 50 * len(words))


def rows(spark, texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kept string")
    return {r.doc_id: r for r in L.judge(docs).collect()}


def test_counts_equal_the_plain_version(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t", "a b c a b c a b", "x\nx\n\nx \n", "é ñ 🎉 #*$", "a\x0bb\x0cc\rd", "word " * 80]
    texts += ["".join(rng.choice(["ab ", "c ", "d\n", "# ", "e. ", "  "]) for _ in range(n)) for n in (5, 60, 400, 5000)]
    got = rows(spark, texts)
    for i, text in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counts(text), text


def test_verdicts(spark):
    numbered = [f"{a} {b} item" for a, b in zip("abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba")]
    menu, long_menu = "Home | News | About | Contact", " | ".join(numbered)
    shout = "!! ".join(f"{a}{i}" for i, a in enumerate("abcdefghij" * 8)) + "!!"
    notice = "\n".join(f"Cookie {n}a {n}b {n}c {n}d {n}e {n}f." for n in range(12))
    got = rows(spark, [CLEAN, f"{menu}\n{CLEAN}\n{menu}", long_menu, shout, notice, CLEAN.replace(" ", " $$ ")])
    assert [got[i].kept for i in range(6)] == [True, True, False, False, False, False]
    assert [got[i].base_failed for i in (2, 3, 4)] == [False] * 3
    assert got[1].n_lost_words == 14 and got[0].n_lost_words == 0


def test_cleaned_texts_lose_their_failing_lines(spark):
    docs = spark.createDataFrame([(1, f"Home | News\n{CLEAN}\n\nRead more about it.", 5), (1, "short.", 6), (None, None, 7)],
                                 "doc_id long, text string, n_words int")
    got = L.clean(docs, keep=("doc_id", "n_words")).select("kept_columns.*", "text").collect()
    assert [tuple(r) for r in got] == [(1, 5, CLEAN)]
    assert L.judge(docs).count() == 3 and L.judge(docs.limit(0)).count() == 0
