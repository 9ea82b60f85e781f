"""Line dedup, MinHash and suffix dedup against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from oracle import assert_same, tables
from tessera.llm import common, components, line_dedup, minhash, queries, suffix_dedup

SF = "/root/testdata/sf0.001"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))


# lines


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_queries_match_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF).toPandas(), tables(SF).sql(queries.ORACLE_SQL[name]).df())


def test_lines_keep_the_last_document(frame):
    line = "A line of more than forty characters, that is held by many."
    texts = [f"first {i}\n {line.upper()}\t\nlast" for i in range(6)] + [f"{line}\n{line}"]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(frame(texts)).collect()}
    assert got[0]["text"] == "first 0\nlast" and got[0]["n_dropped"] == 1 and got[0]["n_lines"] == 3
    assert got[6]["text"] == f"{line}\n{line}" and got[6]["n_dropped"] == 0
    few = {r["doc_id"]: r for r in line_dedup.dedup_lines(frame(texts[:4])).collect()}
    assert few[0]["text"] == texts[0]


def test_lines_all_dropped_and_bitmap(frame):
    line = "another line of more than forty characters for all of them"
    texts = ["\n".join([line] * 3)] * 6
    df = frame(texts)
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(df).collect()}
    assert got[0]["text"] == "" and got[0]["n_dropped"] == 3 and got[5]["text"] == texts[5]
    bitmaps = line_dedup.keep_bitmaps(df).collect()
    assert len(bitmaps) == 5 and all([tuple(b) for b in r["keep_bitmap"]] == [(3, -1)] for r in bitmaps)


def test_lines_odd_rows(odd, none):
    out = line_dedup.dedup_lines(odd)
    assert out.columns == [*odd.columns, "n_lines", "n_dropped"] and out.count() == odd.count()
    assert {r["doc_id"]: (r["text"], r["n_lines"]) for r in out.where("doc_id in (2, 3, 9)").collect()} == {2: ("", 1), 3: ("", 1), 9: ("12\n\n\n34", 4)}
    assert line_dedup.dedup_lines(none).count() == 0


# near copies


def brute_components(texts, n, percent):
    sets = {}
    for i, t in enumerate(texts):
        w = words_of(t)
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("n, percent", [(3, 85), (5, 80)])
def test_components_match_brute_force(frame, n, percent):
    rng = random.Random(n)
    vocabulary = [f"w{i}" for i in range(300)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(30, 120))] for _ in range(12)]
    texts = []
    for base in bases:
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += [None, "", " ", "one", "One", "one two"]
    got = {r["id"]: (r["n_shingles"], r["component"]) for r in minhash.components_of(frame(texts), words=n, percent=percent).collect()}
    assert got == brute_components(texts, n, percent)


def test_blocks_give_the_same_links(frame, monkeypatch):
    rng = random.Random(5)
    base = [f"w{rng.randrange(90)}" for _ in range(60)]
    texts = []
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        texts.append(" ".join(copy))
    monkeypatch.setattr(minhash, "BLOCK", 7)
    got = {r["id"]: r["component"] for r in minhash.components_of(frame(texts), words=3, percent=85).collect()}
    assert got == {i: c for i, (_, c) in brute_components(texts, 3, 85).items()}


def counted(monkeypatch):
    """How many rows each comparison deals to its groups, with the text."""
    sent, plain = [], minhash._compared
    monkeypatch.setattr(minhash, "_compared", lambda texts, dealt, *a: (sent.append(dealt.count()), plain(texts, dealt, *a))[1])
    return sent


def test_large_families_send_each_text_a_few_times(frame, monkeypatch):
    """Near copies that link to their centre meet it once; only what does not is compared with others."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(900)}" for _ in range(100)]
    texts = []
    for k in range(200):
        copy = list(base)
        copy[rng.randrange(100)] = f"x{k}"
        texts.append(" ".join(copy))
    monkeypatch.setattr(minhash, "BLOCK", 10)
    sent = counted(monkeypatch)
    got = minhash.components_of(frame(texts), words=3, percent=85)
    assert {r["component"] for r in got.collect()} == {0}
    assert sent[0] < 3 * 230 and sum(sent[1:]) < 200  # 20 blocks: all against all would be 200 * 20


def family(rng, n, pairs):
    """Documents of 100 words that share most of them and are below the threshold pairwise, and as many close to one of these."""
    base = [f"w{k}" for k in range(100)]
    out = []
    for k in range(n):
        copy, at = list(base), rng.randrange(92)
        copy[at : at + 8] = [f"x{k}_{j}" for j in range(8)]
        out.append(copy)
    out += [[*copy[:99], f"y{k}"] for k, copy in enumerate(out[:pairs])]
    return [" ".join(copy) for copy in out]


@pytest.mark.parametrize("block", [16, 64])
def test_families_below_the_threshold_are_not_sent_to_all_blocks(frame, monkeypatch, block):
    texts = family(random.Random(8), 400, 40)
    monkeypatch.setattr(minhash, "BLOCK", block)
    sent = counted(monkeypatch)
    got = {r["id"]: r["component"] for r in minhash.components_of(frame(texts), words=3, percent=85).collect()}
    assert got == {i: c for i, (_, c) in brute_components(texts, 3, 85).items()} and len({*got.values()}) == 400
    assert sum(sent) < 10 * len(texts)


@pytest.mark.parametrize("one_bucket", [False, True])
def test_open_documents_meet_in_large_rare_clusters(frame, monkeypatch, one_bucket):
    """Several families in one cluster, each larger than a block; also if the rare shingles tell nothing, so that documents stay open after both passes."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(100)]
    texts = []
    for f in range(4):
        own = list(base)
        own[20 * f : 20 * f + 8] = [f"f{f}_{j}" for j in range(8)]
        for k in range(40):
            copy = list(own)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(100)] = f"z{rng.randrange(400)}"
            texts.append(" ".join(copy))
    monkeypatch.setattr(minhash, "BLOCK", 6)
    if one_bucket:
        monkeypatch.setattr(minhash, "_rare_buckets", lambda texts, dealt, *a: dealt.selectExpr("rep", "0L as h").distinct())
    sent = counted(monkeypatch)
    got = {r["id"]: r["component"] for r in minhash.components_of(frame(texts), words=3, percent=85).collect()}
    assert got == {i: c for i, (_, c) in brute_components(texts, 3, 85).items()} and len(sent) == 2 + one_bucket


def test_signature_is_circulant():
    shingles = minhash.shingle_set("a b c d e f g h i j", 3)
    ring = minhash._permute((shingles ^ (shingles >> np.uint64(32))).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    wanted = [minhash._permute(ring + np.uint32(k), 0x85EBCA6B, 0xC2B2AE35).min() for k in range(20)]
    assert minhash.signature(shingles, 20).tolist() == wanted
    assert 1 - (1 - 0.85**minhash.ROWS) ** minhash.bands_for(0.85) >= 1 - minhash.MISS


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 99)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and {got[i] for i in (99, 100, 101)} == {99}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_odd_rows(odd, none):
    got = {(r["id"], r["component"], r["n_shingles"]) for r in minhash.components_of(odd, words=3, percent=85).collect()}
    assert {(1, 1, 1), (6, 1, 1), (2, 2, 0), (3, 3, 0), (4, 4, 0)} <= got
    kept = minhash.near_dedup(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 5, 7, 8, 9]
    assert minhash.near_dedup(none).count() == 0


# passages


def brute_passages(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + length] for b in data for k in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        out.append((len(b), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()), bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize("length, hot", [(40, 2048), (400, 2048), (40, 1), (400, 1), (400, 3)])
def test_passages_match_brute_force(frame, monkeypatch, length, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(length)
    draw = lambda n: "".join(rng.choice("abcdefé \n") for _ in range(n))
    shared = [draw(rng.randint(length // 2, 3 * length)) for _ in range(6)]
    texts = []
    for _ in range(40):
        parts = [draw(rng.randint(0, length))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 3)
            parts += [s[a : len(s) - rng.randint(0, len(s) // 3)], draw(rng.randint(0, length))]
        texts.append("".join(parts))
    texts += [None, "", "a" * (length - 1), "ab" * length, "c" * (3 * length), texts[0], texts[0]]
    got = suffix_dedup.dedup_substrings(frame(texts), length=length, also=length // 2).orderBy("doc_id").collect()
    wanted = brute_passages(texts, length)
    assert [r["dedup"]["n_also"] for r in got] == [n for _, n, *_ in brute_passages(texts, length // 2)]
    assert [(r["dedup"]["n_bytes"], r["dedup"]["n_removed"], r["dedup"]["n_spans"], bytes(r["dedup"]["kept"])) for r in got] == wanted


def test_a_gram_twice_in_a_short_text_is_no_repeat(frame):
    rng = random.Random(12)
    gram = "".join(rng.choice("abcdefgh ") for _ in range(120))
    texts = [gram + "x" + gram + "yz", "q" + gram * 2, gram]
    got = suffix_dedup.dedup_substrings(frame(texts), also=200).orderBy("doc_id").collect()
    assert [(r["dedup"]["n_removed"], r["dedup"]["n_also"]) for r in got] == [(a[1], b[1]) for a, b in zip(brute_passages(texts, 400), brute_passages(texts, 200))]


def test_full_bitmaps_change_nothing(frame, monkeypatch):
    rng = random.Random(9)
    draw = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passages = [draw(500) for _ in range(3)]
    texts = [draw(300) + rng.choice(passages) + draw(300) for _ in range(12)] + [draw(900) for _ in range(5)]
    monkeypatch.setattr(common, "BITS", 1 << 15)
    some = common.bitmap(frame(texts).selectExpr("doc_id * 7 - 20 as h"), "h")
    assert some(np.arange(len(texts)) * 7 - 20).all() and some(np.arange(-1000, 1000)).sum() == len(texts)
    monkeypatch.setattr(common, "bitmap", lambda keys, key: lambda x: np.ones(len(x), bool))
    monkeypatch.setattr(suffix_dedup, "bitmap", common.bitmap)
    monkeypatch.setattr(suffix_dedup, "among", lambda rows, keys, key, apart=False: rows.where("false") if apart else rows)
    got = suffix_dedup.dedup_substrings(frame(texts)).orderBy("doc_id").collect()
    assert [bytes(r["dedup"]["kept"]) for r in got] == [b for *_, b in brute_passages(texts, 400)]


def test_anchors_of_long_texts(monkeypatch):
    data = bytes(np.random.default_rng(1).integers(97, 105, 5000, dtype=np.uint8))
    whole = suffix_dedup.anchors(data, 400)
    monkeypatch.setattr(suffix_dedup, "BATCH", 900)
    pieces = suffix_dedup.anchors(data, 400)
    assert np.array_equal(whole[0], pieces[0])


def test_passages_odd_rows(odd, none):
    out = suffix_dedup.dedup_substrings(odd, as_text=True)
    assert out.columns == [*odd.columns, "dedup"] and out.count() == odd.count()
    row = {r["doc_id"]: r["dedup"] for r in out.collect()}
    assert row[2]["n_bytes"] == 0 and row[5]["n_removed"] == row[5]["n_bytes"] and row[1]["kept"] == "Hello the world"
    assert suffix_dedup.dedup_substrings(none).count() == 0
    clash = odd.selectExpr("doc_id", "text", "source as rid", "source as d", "source as o", "size as spans0", "length as kind", "dropped as start", "lang as h", "lang as `a.b`")
    assert suffix_dedup.dedup_substrings(clash).drop("dedup").collect() and suffix_dedup.dedup_substrings(clash).columns == [*clash.columns, "dedup"]
    assert hashlib.sha256(b"").hexdigest()  # the digest that an empty text has in the query
