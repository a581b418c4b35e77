"""Token alignment against a plain sequential version, with texts cut into many ranges."""

import hashlib
import random
from collections import Counter

import pytest

from quiltframe.llm import encoders, token_alignment as TA

COLUMNS = [c.split()[0] for c in TA.RESULT.split(", ")]


def plain_tokens(text):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{encoders.FOLDER}/{encoders.BYTE_LEVEL}")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{encoders.FOLDER}/{encoders.PIECES}")
    symbols = encoders._byte_symbols()

    def of_piece(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
    ids_b = b.encode(text) if text else []
    parts = [bytes(symbols[c] for c in a.id_to_token(i)) for i in ids_a], [of_piece(i) for i in ids_b]
    whole = (" " + text).encode()
    return (ids_a, ids_b, *parts) if text and b"".join(parts[0]) == whole == b"".join(parts[1]) else ([], [], [], [])


def ends(parts):
    total, out = 0, []
    for part in parts:
        total += len(part)
        out.append(total)
    return out


def brute(rows):
    found = []
    for doc_id, text in rows:
        ids_a, ids_b, parts_a, parts_b = plain_tokens(text or "")
        ends_a, ends_b = ends(parts_a), ends(parts_b)
        links = [(i, j) for i in range(len(ids_a)) for j in range(len(ids_b))
                 if ends_a[i] - len(parts_a[i]) < ends_b[j] and ends_b[j] - len(parts_b[j]) < ends_a[i]]
        groups, low = [], 0
        for end in sorted(set(ends_a) & set(ends_b)):
            groups.append("|".join(",".join(str(x) for x, e in zip(ids, at) if low < e <= end)
                                   for ids, at in ((ids_a, ends_a), (ids_b, ends_b))))
            low = end
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        found.append((doc_id, len(ids_a), len(ids_b), len(groups), [(ids_a[i], ids_b[j]) for i, j in links], digest))
    counts = Counter(pair for row in found for pair in set(row[4]))
    top = Counter()
    for (a, _), n in counts.items():
        top[a] = max(top[a], n)
    return sorted(((d, a, b, g, len(links), sum(counts[p] == top[p[0]] for p in links), sum(counts[p] for p in links), h)
                   for d, a, b, g, links, h in found), key=str)


ODD = ["", " ", "  two", "a  b ", "\n", "x\n y\n\nz", "<|endoftext|> and <s> </s>", "▁ mark", "日本語 の 文", "ﬁne ﬁt",
       "don't 's", "tab\t\tx \x1c y", "é à ü", "🎉 🎉🎉 party", "\x00 nil", "a b c", "word"]


def fixture_rows():
    rng = random.Random(3)
    words = ["amber", "basil,", "Cedar", "thdelta", "emberishly", "ça", "über", "12,345", "🎉", "(fjord)", "the", "of\nGrove"]
    rows = [(i, t) for i, t in enumerate(ODD)]
    rows += [(100 + i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate((3, 9, 40, 90, 170))]
    rows += [(200, "x" * 150), (201, "日本語の文章です。" * 8), (202, "gap " + " " * 90 + "end"), (203, "odd ▁ " * 30)]
    return rows + [(100, rows[17][1]), (None, "no id but text"), (7, None)]


@pytest.mark.parametrize("settings", [{}, {"size": 16, "fan": 2, "most": 200}, {"size": 7, "fan": 3, "most": 50}])
def test_alignment_equals_the_plain_walk(spark, settings):
    rows = fixture_rows()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_a string")
    found = TA.align(docs, **settings)
    assert found.columns == COLUMNS
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows)


def test_composition_is_associative_and_equals_the_whole():
    rng = random.Random(11)
    enc = encoders.load(encoders.FOLDER)
    text = " ".join(rng.choice(["inexplicable", "日本", "the", "of", "🎉", "thdelta"]) for _ in range(60))
    whole = TA.tokens_of(enc, enc.units([text])[0])
    total = int(whole.ends_a[-1])

    def run(cuts, left_first):
        parts, closed = [], []
        for low, high in zip(cuts, cuts[1:]):
            part, inner, start = TA.fragment(whole.between(low, high))
            parts.append(part)
            closed += [inner] if inner is not None else []
        while len(parts) > 1:
            at = 0 if left_first else rng.randrange(len(parts) - 1)
            parts[at:at + 2], group = [(out := TA.compose(parts[at], parts[at + 1]))[0]], out[1]
            closed += [group] if group is not None else []
        closed.append(parts[0].prefix)
        assert not len(parts[0].suffix.a)
        ordered = sorted((c for c in closed if len(c.a)), key=lambda c: c.ends_a[-1])
        return [x for c in ordered for x in c.a.tolist()], [x for c in ordered for x in c.b.tolist()]

    for _ in range(20):
        cuts = [0, *sorted(rng.sample(range(1, total), 12)), total]
        assert run(cuts, True) == run(cuts, False) == (whole.a.tolist(), whole.b.tolist())


def test_empty_table(spark):
    assert TA.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0
