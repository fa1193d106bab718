import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.fs
import pytest
import zstandard
from pyspark.sql import functions as F

from swaraflow.llm import ranking, tokenfiles, turn_trie
from swaraflow.llm.queries import TOKENIZER

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")

# -- op11: ranked search -----------------------------------------------------------------------------

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_terms(text):
    return TERMS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_ranking(docs, items, k=50):
    counted = [(i, Counter(t)) for i, t in ((i, brute_terms(x)) for i, x in docs) if t]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    asked = defaultdict(set)
    for i, x in items:
        asked[i] |= set(brute_terms(x))
    holding = Counter(t for _, c in counted for t in c)
    found = []
    for item, terms in asked.items():
        scores = []
        for i, c in counted:
            m = 100 - 50 + (50 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * holding[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, (i is not None, i), i))
        scores.sort(key=lambda x: x[:2])
        found += [(item, r, i, -s) for r, (s, _, i) in enumerate(scores[:k], 1)]
    return sorted(found, key=str)


def ranked(df):
    return sorted(map(tuple, df.collect()), key=str)


ITEMS = [(1, "Abcd efgh? CHANGED idiot; moron"), (2, None), (2, "scum é中 one-two"), (3, ""), (4, " ".join("abcdefghijklmnop") + " nothing at all changed"), (5, "zzz"), (5, "idiot"), (6, "...!")]


@pytest.mark.parametrize("bounds", [{}, {"SHARD_DOCS": 7}, {"SHARD_POSTINGS": 9}])
def test_ranking(spark, docs, rows, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(ranking, name, value)
    vocabulary = sorted({w for _, t, *_ in rows if t for w in brute_terms(t)})
    items = ITEMS + [(10 + i, " ".join(random.Random(i).sample(vocabulary, 12))) for i in range(12)]
    asked = spark.createDataFrame(items, "item_id long, text string")
    want = brute_ranking([(i, t) for i, t, *_ in rows], items, 10)
    assert ranked(ranking.rank(docs, asked, 10)) == want
    if not bounds:
        assert ranked(ranking.rank(docs, asked, 10, block_pairs=30)) == want


@pytest.mark.parametrize("rounds", [1, 16])
def test_ranking_stops_early_and_keeps_ties(monkeypatch, rounds):
    """A shard of many documents isn't read to its end, but for ties."""
    monkeypatch.setattr(ranking, "ROUNDS", rounds)
    rng = np.random.default_rng(1)
    n, v = 4000, 6
    held = [np.flatnonzero(rng.random(v) < 0.5) for _ in range(n)]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in held])])
    terms = np.concatenate(held)
    impacts = rng.zipf(1.6, len(terms)).clip(1, 10**6)
    shard = ranking.Shard(starts, terms, impacts, np.arange(n), v)
    weights, read = np.array([5, 4, 3, 2, 1, 0]), []
    full = shard.scores
    shard.scores = lambda docs, w: read.append(len(docs)) or full(docs, w)
    docs, scores = shard.best(np.arange(v), weights, 10)
    every = full(np.arange(n), weights)
    order = np.lexsort((np.arange(n), -every))[:10]
    assert docs.tolist() == order.tolist() and scores.tolist() == every[order].tolist() and sum(read) < n / 4
    flat = ranking.Shard(starts, terms, np.ones_like(terms), np.arange(n)[::-1].copy(), v)
    docs, _ = flat.best(np.array([0]), np.array([1, 0, 0, 0, 0, 0]), 5)
    assert docs.tolist() == sorted(i for i in range(n) if 0 in held[i])[-5:][::-1]


def test_ranking_odd_tables(spark, empty):
    schema = "doc_id long, text string, rank int, item_id long, SCORE string"
    odd = [(5, "same words here", 1, 1, "a"), (5, "same words here", 1, 1, "b"), (None, "same words here", 2, 2, "c"), (1, "same words here", 2, 2, None), (2, None, 1, 1, "d"), (3, "...", 1, 1, "e"), (4, "same " * 5000, 0, 0, "f")]
    docs = spark.createDataFrame(odd, schema)
    items = spark.createDataFrame([(1, "SAME words"), (None, "here")], "item_id long, text string")
    assert ranked(ranking.rank(docs, items, 3)) == brute_ranking([r[:2] for r in odd], [(1, "SAME words"), (None, "here")], 3)
    assert ranking.rank(empty, items).collect() == [] and ranking.rank(docs, items.limit(0)).collect() == []
    by_name = spark.createDataFrame([("b", "x y"), ("a", "x y"), ("c", "z")], "doc_id string, text string")
    assert [r["doc_id"] for r in ranking.rank(by_name, spark.createDataFrame([(1, "x")], "item_id long, text string")).orderBy("rank").collect()] == ["a", "b"]


# -- op12: token files -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return public_tokenizers.path(TOKENIZER)


def library(vocabulary):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    t.encode_special_tokens = True
    return lambda text: np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_encoder_equals_library(vocabulary):
    known, whole, rng = tokenfiles.encoder(vocabulary), library(vocabulary), random.Random(2)
    pieces = ["a", "b", " ", "  ", "\n", "\t", "'s", "'", ".", "1", "é", "中", "\u0085", " ", "\x1c", "​", "<|endoftext|>", "word", "Ab,", "!!", "́", "x" * 70]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 12)))
        assert known.encode(text) == whole(text), repr(text)


def brute_files(rows, whole):
    out, start = [], 0
    for i, text in sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (r[0] is not None, r[0], hashlib.md5(r[1].encode()).hexdigest())):
        ids = whole(text) + np.array([2], "<u4").tobytes()
        out.append((i, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    return out


def test_token_files(spark, docs, rows, vocabulary):
    want = brute_files(rows, library(vocabulary))
    files = tokenfiles.write_tokens(docs, vocabulary, file_bytes=4000, frame_ids=100)
    got = sorted(tuple(r) for r in tokenfiles.read_tokens(files).select("id", "start", "n_tokens", F.crc32("ids")).collect())
    assert got == want and files.count() > 5
    # each file is a valid stream of independent frames, the ids of one document in each
    listed = files.orderBy("part", "nth").collect()
    assert [r["first"] for r in listed] == [sum(x["ids"] for x in listed[:i]) for i in range(len(listed))]
    store, at = pyarrow.fs.FileSystem.from_uri(listed[0]["file"])
    with store.open_input_file(at) as source:
        f = tokenfiles.TokenFile(source)
        raw = b"".join(f.ids(k) for k in range(len(f.sizes)))
    with store.open_input_stream(at, compression=None) as source:
        plain = zstandard.ZstdDecompressor().stream_reader(source.read(), read_across_frames=True).read()
    assert np.frombuffer(plain, "<u2").astype("<u4").tobytes() == raw
    assert sorted(tuple(r) for r in tokenfiles.token_index(files).select("id", "start", "n_tokens").collect()) == [w[:3] for w in want]


def test_requested_documents_alone_are_decompressed(spark, docs, rows, vocabulary):
    files = tokenfiles.write_tokens(docs, vocabulary).cache()
    wanted = [3, 7, 11, 40]
    # what isn't asked for may be damaged
    path = files.first()["file"]
    store, at = pyarrow.fs.FileSystem.from_uri(path)
    with store.open_input_file(at) as source:
        f, data = tokenfiles.TokenFile(source), bytearray(source.seek(0) and b"" or source.read())
    k = f.rows.column("id").to_pylist().index(next(i for i in f.rows.column("id").to_pylist() if i not in wanted))
    place = int(f.places[f.frames[k]]) + 12
    data[place] ^= 0xFF
    with store.open_output_stream(at, compression=None) as out:
        out.write(bytes(data))
    want = [w for w in brute_files(rows, library(vocabulary)) if w[0] in wanted]
    got = tokenfiles.requested_tokens(files, spark.createDataFrame([(i,) for i in wanted], "x long"))
    assert sorted(tuple(r) for r in got.select("id", "start", "n_tokens", F.crc32("ids")).collect()) == want
    with pytest.raises(Exception, match="checksum|corrupt|Data|ZstdError|rror"):
        tokenfiles.read_tokens(files).collect()


def test_token_files_of_odd_tables(spark, empty, vocabulary):
    assert tokenfiles.read_tokens(tokenfiles.write_tokens(empty, vocabulary)).collect() == []
    odd = [(None, "a b", "x"), (2, None, "y"), (2, "", "z"), (2, "b a", None), (2, "b a", "x"), (1, "w " * 40_000, "x"), (0, "  lead and trail \n", "x")]
    docs = spark.createDataFrame(odd, "doc_id long, text string, Ids string").repartition(3)
    got = tokenfiles.read_tokens(tokenfiles.write_tokens(docs, vocabulary)).select("id", "start", "n_tokens", F.crc32("ids")).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == brute_files(odd, library(vocabulary))


def test_files_of_other_attempts_do_not_count(spark, docs, vocabulary):
    """Attempts have files of their own; the table names those of the ones that were committed."""
    from swaraflow.sources.shared import shared_dir

    folder = f"{shared_dir(spark)}/tokens-of-two-attempts"
    tokenfiles.write_tokens(docs, vocabulary, folder=folder)
    files = tokenfiles.write_tokens(docs, vocabulary, folder=folder)
    store, at = pyarrow.fs.FileSystem.from_uri(folder)
    assert len(store.get_file_info(pyarrow.fs.FileSelector(at))) == 2 * files.count()
    assert tokenfiles.read_tokens(files).count() == docs.count()


# -- op13: conversation trie -------------------------------------------------------------------------


def conversations(n=160, seed=3):
    rng, rows = random.Random(seed), []
    said = ["hello there", "how are you", "fine thanks and you", "", None, "a b c d e"]
    for c in range(n):
        if c in (20, 60):  # families without their first
            continue
        turns = 90 if c in (5, 6, 85) else rng.choice([1, 1, 2, 3, 5, 8])
        for t in range(turns):
            text = "again" if c in (5, 6, 85) and t < 80 else rng.choice(said[: 2 + t % 5])
            rows.append((c, t, rng.choice(["user", "bot"][: 1 + t % 2]) if t != 1 else None, text))
    rows += [(c, None, "sys", "first") for c in range(100, 110)]
    rows += [(1000 + 20 * k + 1, 0, "user", "one very common conversation") for k in range(80)]
    rng.shuffle(rows)
    return rows


def brute_trie(rows, rebuilt=True):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((t is not None, t), role, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), text))
    seqs = {c: [(r, x) for _, r, _, x in sorted(v)] for c, v in own.items()}
    if rebuilt:
        donors = seqs
        seqs = {}
        for c, s in donors.items():
            h = zlib.crc32(str(c).encode()) % 4
            seqs[c] = donors.get(c - c % 20, [])[:h] + s[h:]
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    totals = {}
    for p in sorted(members, key=len, reverse=True):
        saved = (len(members[p]) - 1) * (len(WORDS.findall(p[-1][1])) if p else 0)
        totals[p] = (sum(totals[k][0] for k in kids[p]) or 1, saved + sum(totals[k][1] for k in kids[p]))
    out = []
    for p, cs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(seqs[c]) == len(p)))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids[p]), *totals[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("bounds", [{}, {"range_rows": 11, "run_rows": 9}, {"range_rows": 3, "run_rows": 50}, {"range_turns": 60}])
def test_trie(spark, bounds):
    rows = conversations()
    turns = spark.createDataFrame(rows, TURNS).repartition(3)
    got = sorted((tuple(r) for r in turn_trie.trie_nodes(turn_trie.branched_paths(turns), **bounds).collect()), key=str)
    assert got == brute_trie(rows)
    if bounds.get("range_rows") == 11:
        got = sorted((tuple(r) for r in turn_trie.trie_nodes(turn_trie.paths(turns), **bounds).collect()), key=str)
        assert got == brute_trie(rows, rebuilt=False)


@pytest.mark.parametrize("seed", range(6))
def test_ranges_cut_anywhere_give_the_same_trie(monkeypatch, seed):
    monkeypatch.setattr(turn_trie, "PIECE", 2)
    rng = random.Random(seed)
    turn = [bytes([i]) * turn_trie.TURN for i in range(2)]
    rows = sorted((b"".join(rng.choice(turn[: 1 + (d > 1)]) for d in range(rng.choice([0, 1, 2, 2, 4, 6]))), i) for i in range(60))

    def nodes(cuts):
        whole, shares = [], []
        for part, (i, j) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
            stream = [(p, c, [1] * 9, turn_trie.common_turns(rows[k - 1][0], p) if k > i else 0) for k, (p, c) in enumerate(rows[i:j], i)]
            for r in turn_trie.finished_nodes(stream, part):
                (whole if r[2] == turn_trie.WHOLE else shares).append(r)
        found = whole + list(turn_trie.stitched_nodes([(r[2], r[3], r[4], r[6], *r[8:14]) for r in shares]))
        return sorted((r[4], r[3], *r[8:12], r[14]) for r in found)

    once = nodes([])
    assert once[0][2] == 60
    for _ in range(20):
        assert nodes(sorted(rng.sample(range(1, len(rows)), rng.randrange(1, 12)))) == once


def test_trie_of_odd_tables(spark):
    none = spark.createDataFrame([], TURNS)
    assert turn_trie.trie_nodes(turn_trie.branched_paths(none)).collect() == []
    odd = [(None, 0, "a", "b"), (-3, 0, "a", "b"), (0, 5, None, None), (0, 5, None, None), (7, None, "a", "x y"), (7, 1, "a", "x y"), (41, 0, "u", "gone"), (3, 0, "u", "w " * 30_000)]
    turns = spark.createDataFrame([(*r, "extra", 1) for r in odd], TURNS + ", path string, N_Convs int")
    want = [r for r in odd if r[0] is None or r[0] >= 0]
    got = sorted((tuple(r) for r in turn_trie.trie_nodes(turn_trie.branched_paths(turns.filter("conv_id is null or conv_id >= 0")), range_rows=2).collect()), key=str)
    assert got == brute_trie(want)
    assert turn_trie.trie_nodes(turn_trie.branched_paths(turns)).filter("depth = 0").first()["n_convs"] == 5


def test_loser_tree_compares_shared_turns_once(monkeypatch):
    """Merging runs of paths with a long common beginning looks at it once a run."""
    rng = random.Random(4)
    turn = [bytes([i]) * turn_trie.TURN for i in range(6)]
    paths = [(b"".join([turn[0]] * 50 + [rng.choice(turn) for _ in range(4)]), i, None) for i in range(300)]
    runs = []
    for k in range(5):
        part = sorted(paths[k::5], key=lambda x: x[:2])
        runs.append([(*x, turn_trie.common_turns(part[i - 1][0], x[0]) if i else 0) for i, x in enumerate(part)])
    starts = []
    real = turn_trie.common_turns
    monkeypatch.setattr(turn_trie, "common_turns", lambda a, b, start=0: starts.append(start) or real(a, b, start))
    merged = list(turn_trie.LoserTree(runs))
    assert [x[:2] for x in merged] == sorted(x[:2] for x in paths)
    assert all(x[3] == real(y[0], x[0]) for y, x in zip(merged, merged[1:], strict=False))
    assert sum(s < 50 for s in starts) <= len(runs)
