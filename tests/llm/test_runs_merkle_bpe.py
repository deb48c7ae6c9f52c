"""Periodic runs, Merkle manifest and byte-pair encoding against plain versions."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import SF, awkward_rows
from transloom.llm import merkle, pair_bpe, periodic_runs, registry
from transloom.llm.pair_bpe import PairIndex, Tokens

CASES = ["docs", "awkward", "empty"]


def crc(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


# --- op11 ---------------------------------------------------------------------------------------
def plain_runs(words, min_length=6, min_exponent=4):
    """(start, end, period) by trying each period at each place."""
    n, found = len(words), {}
    for p in range(1, n // min_exponent + 1):
        x = 0
        while x < n - p:
            y = x
            while y < n - p and words[y] == words[y + p]:
                y += 1
            if y > x and y + p - x >= max(min_length, min_exponent * p):
                found.setdefault((x, y + p), p)
            x = y + 1
    return sorted((s, e, p) for (s, e), p in found.items())


def plain_report(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), crc(doc_id)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = sorted((s, e - s, p) for s, e, p in plain_runs(words))
    dropped = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    return (doc_id, n, len(runs), *best, None if not runs else 1000 * best[1] // best[2],
            sha("".join(f"{s},{m},{p}\n" for s, m, p in runs)), sha(b" ".join(w for i, w in enumerate(words) if i not in dropped)))


@pytest.mark.parametrize("slab", [1, 7, 1000])
def test_square_catcher(slab):
    r = random.Random(5)
    for _ in range(250):
        n = r.randint(0, 70)
        words = [r.randrange(r.choice([1, 2, 3, 6])) for _ in range(n)]
        if n > 5 and r.random() < 0.6:
            s, p = r.randrange(n), r.randint(1, 9)
            words = [w if i < s else words[s + (i - s) % p] for i, w in enumerate(words)]
        for limits in ((2, 2), (6, 4)):
            got = periodic_runs.word_runs(np.array(words, np.int64), n, *limits, slab)
            assert list(zip(*(c.tolist() for c in got))) == plain_runs(words, *limits), words


def test_run_of_a_whole_long_text():
    words = np.arange(40_000) % 613
    start, end, period = periodic_runs.word_runs(words, len(words))
    assert (start.tolist(), end.tolist(), period.tolist()) == ([0], [40_000], [613])
    start, end, period = periodic_runs.word_runs(np.zeros(30_000, np.int64), 30_000, slab=1 << 10)
    assert (start.tolist(), end.tolist(), period.tolist()) == ([0], [30_000], [1])


def short(df):
    """A brute-force run search is quadratic: the texts of at most 3,000 characters, and the awkward long one cut."""
    return df.withColumn("text", F.substring("text", 1, 3000))


@pytest.mark.parametrize("which", CASES)
def test_run_report(which, request):
    df = short(request.getfixturevalue(which))
    got = [tuple(r) for r in periodic_runs.run_report(df, tail=periodic_runs.planted_tail).collect()]
    want = [plain_report(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert which != "docs" or sum(r[2] for r in got) > 10


def test_op11_query(spark, docs):
    got = registry.op11_periodic_runs(spark, SF).collect()
    assert len(got) == docs.count() and all((r["n_runs"] == 0) == (r["start"] is None) for r in got)


# --- op12 ---------------------------------------------------------------------------------------
def plain_field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_leaf(row, text):
    return sha("".join(map(plain_field, (row[0], row[3], row[2], row[4], text))))


def plain_tree(nodes):
    """(root, for each node the list of (siblings to the left, siblings to the right))."""
    paths, under = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, below = [], []
        for i in range(0, len(nodes), 3):
            run = nodes[i:i + 3]
            for j in range(len(run)):
                for leaf in under[i + j]:
                    paths[leaf].append((run[:j], run[j + 1:]))
            up.append(sha("".join(run)))
            below.append([leaf for u in under[i:i + 3] for leaf in u])
        nodes, under = up, below
    return nodes[0], paths


def plain_manifest(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    groups = {}
    for row in rows:
        groups.setdefault(row[3], []).append((row[0] is not None, row[0] or 0, plain_leaf(row, row[1]), row))
    names = sorted(groups, key=lambda s: b"" if s is None else b"s" + s.encode())
    trees = {s: plain_tree([g[2] for g in sorted(groups[s], key=lambda g: g[:3])]) for s in names}
    root, tops = plain_tree([trees[s][0] for s in names]) if names else (None, [])
    out = []
    for s, top in zip(names, tops):
        for (_, _, leaf, row), path in zip(sorted(groups[s], key=lambda g: g[:3]), trees[s][1]):
            text = row[1].replace("\n", "") if row[1] is not None and crc(row[0]) % 2 == 0 else row[1]
            folded = plain_leaf(row, text)
            for left, right in path + top:
                folded = sha("".join([*left, folded, *right]))
            proof = sha("".join(h for left, right in path + top for h in left + right))
            out.append((row[0], leaf, trees[s][0], root, proof, folded, folded == root))
    return sorted(out, key=str)


def shown(text):
    return F.when(registry.crc_mod(F.col("doc_id"), 2) == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


@pytest.mark.parametrize("which", CASES)
def test_manifest(which, request):
    df = request.getfixturevalue(which)
    rows = [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = sorted((tuple(r) for r in merkle.manifest(df, shown=shown).collect()), key=str)
    assert got == plain_manifest(rows)
    if which == "docs":
        assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("levels", [1, 2])
def test_manifest_in_many_blocks(spark, levels):
    """Rounds of block roots, uneven last blocks, and one group with most of the rows."""
    sizes = {None: 1, "": 2, "a": 3, "b": 10, "Z": 28, "hot": 95, "é": 9, "x": 27}
    rows = [(i, f"text {i}\n{i % 3}", "en", s, i) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((tuple(r) for r in merkle.manifest(df, shown=shown, levels=levels).collect()), key=str)
    assert got == plain_manifest(rows)


def test_witnesses_grow_as_leaves_come():
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(25)]
    for n in range(1, len(leaves) + 1):
        grown = merkle.Witnesses()
        for leaf in leaves[:n]:
            grown.append(leaf)
        root = grown.finish(merkle.height(n))
        assert root.hex() == plain_tree([h.hex() for h in leaves[:n]])[0]
        assert all(merkle.fold(h, bytes(s), b"".join(w)) == root for h, s, w in zip(leaves, grown.shapes, grown.siblings))


# --- op13 ---------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def word_bpe():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def library_report(library, doc_id, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


@pytest.mark.parametrize("which", CASES)
def test_bpe_report(which, request, word_bpe):
    df = request.getfixturevalue(which)
    library = Tokenizer.from_str(word_bpe)
    got = [tuple(r) for r in pair_bpe.encode_report(df, word_bpe).collect()]
    want = [library_report(library, r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_bpe_of_odd_texts(word_bpe):
    """Other scripts, marks, controls, special tokens, and pre-tokens of many thousand letters."""
    r = random.Random(2)
    pool = "abcAÉéßİıſµªº²¼ \t\n\x0b\x1c\x85\xa0ﬁ漢字カ́'s'T'll're12٣!?#--😀ǅΣς\x00\x7f\xad"
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 60))) for _ in range(800)]
    texts += ["".join(chr(r.randrange(256)) for _ in range(60)) for _ in range(300)]
    texts += ["<|endoftext|>", "x<|endoftext|>y <|startoftext|>'s", "<|ENDOFTEXT|>", "a" * 30_000, "aB" * 20_000]
    texts += ["".join(map(chr, range(i, i + 0x200))) for i in range(0, 0xD800, 0x200)]
    library, own = Tokenizer.from_str(word_bpe), Tokens(word_bpe)
    for text, (n, ids, decoded) in zip(texts, own.encode_batch(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert (n, ids.decode()) == (len(want), " ".join(map(str, want))), text
        assert decoded.decode() == library.decode(want, skip_special_tokens=False)


def test_pair_index_takes_the_lowest_rank_first():
    """Against merging one pair at a time in each word."""
    r = random.Random(4)
    merges = {}
    for rank in range(14):
        merges.setdefault((r.randrange(3 + rank), r.randrange(3 + rank)), (rank, 3 + rank))
    words = [[r.randrange(3) for _ in range(r.randint(0, 30))] for _ in range(400)]

    def plain(word):
        while True:
            ranked = [(merges[p][0], i) for i, p in enumerate(zip(word, word[1:])) if p in merges]
            if not ranked:
                return word
            rank, i = min(ranked)
            word = [*word[:i], 3 + rank, *word[i + 2:]]

    index = PairIndex([list(w) for w in words], merges)
    index.merge_all()
    assert list(index.words()) == [plain(w) for w in words]


def test_cache_of_pre_tokens_is_bounded(word_bpe, monkeypatch):
    monkeypatch.setattr(pair_bpe, "CACHE", 10)
    own, library = Tokens(word_bpe), Tokenizer.from_str(word_bpe)
    for text in [t for _, t, *_ in awkward_rows() if t]:
        (n, ids, _), = own.encode_batch([text])
        want = library.encode(text, add_special_tokens=False).ids
        assert (n, ids.decode()) == (len(want), " ".join(map(str, want)))
