"""Operators 11 and 13 against the tokenizers' libraries, operator 12 against NumPy."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", "　", "​", "᠎", "a", "the", "'s", "'ll", "12", "é", "ß", "日本", "🙂", "<|endoftext|>", "<s>", "<unk>", ".", ",\n", ")\r", "▁", "▁▁", "½", "́", "x" * 50, " and", "\x00", "\n\n\n", "\v"]


@pytest.fixture(scope="module")
def odd_texts():
    r = random.Random(3)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 25))) for _ in range(1200)] + [None, "", " ", "\n", "x" * 5000, " " * 700 + "a", "ab" * 4000 + " c\n" * 3000, "a b", "a b"]


def table(spark, texts):
    return spark.createDataFrame([(None if i % 50 == 49 else i // 2, t, 7, 8) for i, t in enumerate(texts)], "doc_id long, text string, ids int, links int").repartition(5)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_byte_bpe_is_the_librarys(spark, odd_texts, texts):
    from tokenizers import Tokenizer

    from pulsegrid.llm.byte_bpe import round_trip_digest

    library, expected = Tokenizer.from_file(A), []
    docs = table(spark, odd_texts + texts)
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        expected.append((r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, round_trip_digest(docs, A).collect()), key=repr) == sorted(expected, key=repr)
    assert round_trip_digest(docs.limit(0), A).count() == 0


def test_byte_bpe_decodes_any_ids(spark):
    from tokenizers import Tokenizer

    from pulsegrid.llm.byte_bpe import decoded, encoded

    r, library = random.Random(4), Tokenizer.from_file(A)
    lists = [[r.randrange(50257) for _ in range(r.randint(0, 9))] for _ in range(400)] + [None]
    found = decoded(spark.createDataFrame([(i, x, "kept") for i, x in enumerate(lists)], "n int, ids array<int>, text string"), A).collect()
    assert {x["n"]: x["text"] for x in found} == {i: library.decode(x or [], skip_special_tokens=False) for i, x in enumerate(lists)}
    kept = encoded(spark.createDataFrame([("é b", 1.5, [3])], "text string, other double, ids array<int>"), A)
    assert [tuple(x) for x in kept.collect()] == [(1.5, library.encode("é b").ids)]


def test_byte_bpe_forgets(texts):
    from pulsegrid.llm.byte_bpe import ByteBpe

    few, many = ByteBpe(A, limit=3), ByteBpe(A)
    assert all(few.encode(t) == many.encode(t) for t in texts if t)
    assert len(few.known) == len(few.splits) == 3


def plain_alignment(rows):
    """From whole texts, over all pairs of tokens of a text."""
    from pulsegrid.llm.tokenizer_alignment import TokenizerPair

    p, found, documents = TokenizerPair(A, B), [], collections.Counter()
    for i, t in rows:
        whole = (" " + (t or "")).encode()
        a, b = (p.a.encode(" " + t, add_special_tokens=False).ids, p.b.encode(t)) if t else ([], [])
        spans = []
        for ids, strings in ((a, p.a_bytes), (b, p.b_bytes)):
            ends = np.cumsum([0] + [len(strings[x]) for x in ids]).tolist()
            spans.append(list(zip(ids, ends, ends[1:])))
        if not t or any(b"".join(s[x] for x in ids) != whole for ids, s in ((a, p.a_bytes), (b, p.b_bytes))):
            found.append((i, [], [], [], []))
            continue
        links = [(x, y) for x, s, e in spans[0] for y, u, v in spans[1] if max(s, u) < min(e, v)]
        groups, low = [], 0
        for high in sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]}):
            groups.append("|".join(",".join(str(x) for x, _, e in side if low < e <= high) for side in spans))
            low = high
        documents.update(set(links))
        found.append((i, a, b, groups, links))
    most = collections.Counter()
    for (x, _), n in documents.items():
        most[x] = max(most[x], n)
    return [(i, len(a), len(b), len(g), len(ls), sum(documents[x] == most[x[0]] for x in ls), sum(documents[x] for x in ls), sha(";".join(g)) if g else "") for i, a, b, g, ls in found]


def test_alignment_against_whole_texts(spark, odd_texts, texts, monkeypatch):
    from pulsegrid.llm import tokenizer_alignment

    docs = table(spark, [t for t in odd_texts + texts if len(t or "") < 6000])
    expected = sorted(plain_alignment([(r["doc_id"], r["text"]) for r in docs.collect()]), key=repr)
    assert sum(x[1] > 0 for x in expected) > 400 < sum(x[1] == 0 for x in expected)
    for chunk in (1 << 24, 500):  # one chunk a task, and many
        monkeypatch.setattr(tokenizer_alignment, "CHUNK", chunk)
        assert sorted(map(tuple, tokenizer_alignment.alignment_digest(docs, A, B).collect()), key=repr) == expected


def test_alignment_of_nothing(spark, docs):
    from pulsegrid.llm.tokenizer_alignment import alignment_digest

    assert alignment_digest(docs.limit(0), A, B).count() == 0
    empty = spark.createDataFrame([(1, None), (2, ""), (None, "")], "doc_id long, text string")
    assert sorted(map(tuple, alignment_digest(empty, A, B).collect()), key=repr) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")]


def test_cuts_are_read_from_the_vocabularies():
    from pulsegrid.llm.segments import never_behind
    from pulsegrid.llm.tokenizer_alignment import TokenizerPair

    assert never_behind(["▁▁", "▁a", "b\n"], "▁") == {" ", "\t", "\v", "\f", "\r"}
    assert " " not in never_behind(["a▁b"], "▁")
    assert TokenizerPair(A, B).cuts == {" ", "\n", "\t", "\v", "\f"}  # a piece has ")" before "\r"


@pytest.mark.parametrize("size", [5, 40])
def test_whitening_against_numpy(spark, size):
    from pulsegrid.llm import embedding_whitening

    r = np.random.default_rng(size)
    vectors = r.normal(size=(300, size)) @ r.normal(size=(size, size)) + r.normal(size=size) * 5
    good = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(None, vectors[3].tolist()), (7, vectors[7].tolist())]
    bad = [(900, None), (901, []), (902, [None] * size), (903, [float("nan")] * size), (904, [float("-inf")] + [1.0] * (size - 1)), (905, [1.0])]
    rows = spark.createDataFrame([(i, v, 1, "c") for i, v in good + bad], "vec_id long, embedding array<double>, n int, w string").repartition(3)
    found = embedding_whitening.whitened_embeddings(rows).collect()
    x = np.array([np.floor(64 * np.array(v)) + 1_000_000 for _, v in good]).astype(int)
    n, sums = len(x), x.sum(0)
    centred = x - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    kept = min(size, 32)
    white = centred @ axes[:, :kept] / np.sqrt(values[:kept])
    assert len(found) == n * kept
    deviations, seen = collections.Counter(((n * x - sums) ** 2).sum(1).tolist()), collections.defaultdict(list)
    assert collections.Counter(f["deviation"] for f in found) == {d: k * kept for d, k in deviations.items()}
    for f in found:
        assert f["n"] == n and f["identity_error"] < 1e-9
        assert f["explained"] == pytest.approx(values[f["component"] - 1] / values.sum(), rel=1e-9)
        seen[f["component"]].append((f["deviation"], f["whitened"]))
    order = np.argsort(((n * x - sums) ** 2).sum(1), kind="stable")
    for k, own in seen.items():
        own = np.array([w for _, w in sorted(own)])
        plain = np.array([w for _, w in sorted(zip(((n * x - sums) ** 2).sum(1)[order].tolist(), white[order, k - 1].tolist()))])
        other = np.array([w for _, w in sorted(zip(((n * x - sums) ** 2).sum(1)[order].tolist(), (-white[order, k - 1]).tolist()))])
        assert min(np.abs(own - plain).max(), np.abs(own - other).max()) < 1e-6


def test_whitening_of_few_and_far_vectors(spark):
    from pulsegrid.llm.embedding_whitening import whitened_embeddings

    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 1e300]), (3, [0.5, 7.0])], "vec_id long, embedding array<double>")
    far = whitened_embeddings(rows).collect()
    assert {f["deviation"] for f in far} == {None} and {f["component"] for f in far} == {1}
    assert whitened_embeddings(rows.limit(1)).count() == whitened_embeddings(rows.limit(0)).count() == 0
    one = whitened_embeddings(rows.where("vec_id <> 2")).collect()  # two vectors span one component
    assert sorted(round(f["whitened"], 9) for f in one) == [-1.0, 1.0] and one[0]["explained"] == pytest.approx(1.0)
