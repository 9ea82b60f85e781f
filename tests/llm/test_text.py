"""Quality rules, BPE, fingerprints, language ID and packing."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as tok
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe, divergence, language, packing, parsing, queries

SF = "/root/testdata/sf0.001"
RANKS, JSON = tok.path("byte_bpe_50k.tiktoken"), tok.path("byte_bpe_50k.json")
WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")


# quality rules


def brute_base(text):
    w = re.findall(WORD, text or "")
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    at = {}
    for k in range(len(w) - 7):
        at.setdefault(tuple(w[k : k + 8]), []).append(k)
    repeated = {k + j for v in at.values() if len(v) > 1 for k in v for j in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated)


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_base_counts(spark, documents):
    for r in queries.op1_divergence(spark, SF).collect():
        wanted = brute_base(documents.text[r["doc_id"]])
        assert tuple(r[c] for c in BASE) == wanted
        assert r["base_failed"] == (wanted[0] < 20 or 100 * wanted[4] > 30 * wanted[0]) and not (r["base_failed"] and r["kept"])


def test_repeats_on_small_texts(frame):
    texts = ["a b c d e f g h " * 2, "a b c d e f g h i", "x " * 30, "a b c d e f g h z a b c d e f g h", None, "", "é # ü\n\n é # ü\né # ü "]
    refs = divergence.references(frame(texts))
    got = divergence.judge(frame(texts), refs).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in BASE) for r in got] == [brute_base(t) for t in texts]


def jensen_shannon(p, q):
    m = (p + q) / 2
    part = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m) if x > 0)
    return np.sqrt((part(p) + part(q)) / 2)


def test_distances_match_numpy(frame):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["the", "of", "and", "Rare", "x1", "é,"]) for _ in range(rng.randint(1, 80))) for _ in range(30)]
    refs = divergence.references(frame(texts))
    shares = refs.words["en"]
    assert set(refs.owners.values()) == {"the", "of", "and", "Rare", "x1", "é,"}
    for r in divergence.judge(frame(texts), refs).collect():
        words = texts[r["doc_id"]].split()
        p = np.array([words.count(refs.owners[s]) / len(words) for s in shares])
        assert r["word_js"] == pytest.approx(jensen_shannon(p, np.array(list(shares.values()))), abs=1e-6)
        t = texts[r["doc_id"]]
        counts = [t.count(" "), sum("A" <= c <= "Z" for c in t), sum(c.isdigit() for c in t), t.count(","), t.count("é")]
        q = np.array([*counts, len(t) - sum(counts)]) / len(t)
        assert r["class_js"] == pytest.approx(jensen_shannon(q, np.array(refs.classes["en"])), abs=1e-6)


def test_every_common_word_of_many_languages(spark):
    """Eighty languages that share words: no word is lost, and the nearest of all is found by brute force."""
    rng = random.Random(2)
    pool = [f"w{i}" for i in range(4000)]
    own = {f"l{k:02}": rng.sample(pool, divergence.COMMON) for k in range(80)}
    prose = lambda lang, n: " ".join(rng.choice(own[lang]) if rng.random() < 0.4 else rng.choice("bcdfg") * rng.randint(9, 60) + str(rng.random()) for _ in range(n))
    train = [(i, " ".join(own[lang] * 3) + " " + prose(lang, 300), lang) for i, lang in enumerate(own)]
    refs = divergence.references(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert all({refs.owners[s] for s in refs.words[lang]} == set(own[lang]) for lang in own)
    names = list(own)
    texts = [prose(names[i], 70) + " " + prose(names[-i - 1], 30) for i in range(25)] + [" ".join(f"none{i}" for i in range(80)), "w1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in divergence.judge(docs, refs).collect():
        words = texts[r["doc_id"]].split()
        counts = {s: words.count(w) / len(words) for s, w in refs.owners.items()}
        p = np.array([*counts.values(), 1 - sum(counts.values())])
        q = [np.array([*(refs.words[lang].get(s, 0.0) for s in counts), 1 - sum(refs.words[lang].values())]) for lang in own]
        assert r["word_js"] == pytest.approx(min(jensen_shannon(p, x) for x in q), abs=1e-6)


def test_slots_are_apart():
    rng = random.Random(4)
    for n in (0, 1, 300, 9000):
        hashes = {f"w{i}": rng.getrandbits(64) - 2**63 for i in range(n)}
        slots, shifts = divergence.place(hashes)
        size = len(shifts)
        assert len(set(slots.values())) == len(slots) == n and size & (size - 1) == 0
        assert all(slots[w] == ((h & (2**64 - 1)) >> shifts[h & (size - 1)]) & (size - 1) for w, h in hashes.items())


def test_junk_goes_and_prose_stays(spark, documents):
    kept = {r["doc_id"]: r for r in queries.op1_divergence(spark, SF).collect()}
    junk = [i for i, t in documents.text.items() if len(re.findall("[#*$%&]{3}", t)) > 0.02 * len(t)]
    assert not any(kept[i]["kept"] for i in junk if kept[i]["n_words"] >= 60)
    clean = [i for i, t in documents.text.items() if i not in junk and t.count("|") < 0.02 * len(t) and not kept[i]["base_failed"]]
    assert np.mean([kept[i]["kept"] for i in clean]) > 0.99


def test_texts_without_common_words_go(spark):
    """Gibberish and lists of rare words go at any length that is judged, prose of one language or of several stays."""
    rng = random.Random(3)
    rare = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9)))
    common = {lang: [f"{lang}{c}" for c in "abcdefghijklmnop"] for lang in ("en", "de", "es")}
    prose = lambda lang, n: " ".join(rng.choice(common[lang]) if rng.random() < 0.3 else rare() for _ in range(n))
    rows = [(1000 * k + i, prose(lang, 300), lang) for k, lang in enumerate(common) for i in range(60)]
    junk = [(10_000 + n, " ".join(rare() for _ in range(n)), "en") for n in (60, 300, 5000)]
    mixed = [(20_000, " ".join(prose(lang, 300) for lang in common), "en"), (20_001, prose("en", 60), "en")]
    docs = spark.createDataFrame(rows + junk + mixed, "doc_id long, text string, lang string")
    refs = divergence.references(spark.createDataFrame(rows, docs.schema))
    got = {r["doc_id"]: r for r in divergence.judge(docs, refs, lang_col="lang").collect()}
    assert all(not got[i]["kept"] and not got[i]["base_failed"] and got[i]["word_js"] < divergence.MOST_WORDS_JS for i, *_ in junk)
    assert all(got[i]["kept"] for i, *_ in rows + mixed)


def test_labels_without_a_reference_are_judged_by_the_pool(frame, spark):
    """Junk goes whatever its label; prose of rare languages stays, in any script; words are not judged where no reference can tell."""
    prose = [" ".join(["the of and to in"] * 10 + [f"word{i} more words. And, so"] * 8) for i in range(200)]
    refs = divergence.references(frame(prose))
    rng = random.Random(4)
    junk = ["".join(rng.choice("#*$%&|<>[]{}=+ ") for _ in range(900)), " ".join(str(rng.randrange(10**6)) for _ in range(150))]
    rare = ["".join(rng.choice("абвгдежзиклмнопрст") + (" " if rng.random() < 0.18 else "") for _ in range(900)) + ".", "。".join("".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(20)) + " " for _ in range(30)), " ".join(f"zq{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200))]
    rows = [(k * 10 + i, text, label) for k, label in enumerate(["zz", "en", None]) for i, text in enumerate(junk + rare)]
    got = {r["doc_id"]: r for r in divergence.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), refs, lang_col="lang").collect()}
    assert not any(got[k * 10 + i]["kept"] for k in range(3) for i in range(2)) and not any(got[i]["base_failed"] for i in (1, 2, 4))
    assert all(got[2 + i]["kept"] for i in range(3)) and not got[12]["kept"] and not got[14]["kept"]


def test_languages_are_bounded(spark, monkeypatch):
    """Ten thousand labels give a plan of bounded size, and those beyond the bound are judged by the pool."""
    import time

    docs = spark.range(20_000).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 30), i -> concat('w', (id * 31 + i * i) % 5000))) as text", "concat('l', id % 10000) as lang")
    monkeypatch.setattr(divergence, "ENOUGH_WORDS", 1)
    began = time.time()
    refs = divergence.references(docs)
    divergence.judge(docs, refs, lang_col="lang")
    assert len(refs.classes) == divergence.LANGUAGES and time.time() - began < 60


def test_rules_odd_rows(odd, none):
    got = divergence.judge(odd, divergence.references(odd))
    assert got.count() == odd.count()
    assert {r["doc_id"]: (r["n_words"], r["kept"], r["word_js"]) for r in got.where("doc_id in (2, 3)").collect()} == {2: (0, False, None), 3: (0, False, None)}
    assert divergence.judge(none, divergence.references(none)).count() == 0
    assert divergence.judge(odd, divergence.references(none)).where("doc_id = 1").first()["word_js"] is None


# BPE

_codec = bpe.codec(RANKS, tok.PATTERN)
_spaced = bpe.SpacedCodec(bpe.read_ranks(RANKS), tok.PATTERN)
_library = tiktoken.Encoding("own", pat_str=tok.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(" \n\t\r ab1'sré漢!.\x1c") | st.characters(exclude_categories=["Cs"]), max_size=40))
def test_bpe_matches_library(text):
    ids = np.frombuffer(_codec.encode(text), np.uint32).tolist()
    assert ids == _library.encode_ordinary(text) and _codec.decode(ids) == text.encode()
    assert np.frombuffer(_spaced.encode(text), np.uint32).tolist() == ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", " ", "\n", "word", "'re", " x", "123", "!!", "  "]), min_size=20, max_size=200), st.integers(1, 40))
def test_stitched_chunks_are_those_of_the_whole(parts, run):
    text = "".join(parts) + "z" * run * 5 + "".join(parts)
    whole = _codec.find(text)
    assert bpe.stitch(_codec.find, text, 48, 12) == whole and bpe.stitch(_codec.find, text, 20, 6) == whole


@pytest.mark.parametrize("text", ["a" * 9000, " " * 9000, "\n" * 5000 + "a", "1" * 7000 + " x" * 3000, ("word " * 500 + "!" * 5000) * 3, "x\n \n" * 3000])
def test_runs_over_many_chunks(text):
    assert bpe.stitch(_codec.find, text) == _codec.find(text)
    assert np.frombuffer(_codec.encode(text), np.uint32).tolist() == _library.encode_ordinary(text)


def test_another_pattern():
    pattern = r"\w+|[^\w\s]|\s+"
    find = bpe.Codec(bpe.read_ranks(RANKS), pattern).find
    text = "".join(random.Random(4).choice(["ab", " ", "\n", ".", "é9"]) for _ in range(9000))
    assert bpe.stitch(find, text) == find(text)


def test_bpe_columns(odd, none):
    out = odd.select("doc_id", "text", bpe.encoder(RANKS, tok.PATTERN)("text").alias("ids")).select("*", bpe.decoder(RANKS, tok.PATTERN)("ids").alias("back"))
    for r in out.collect():
        assert r["ids"] == _library.encode_ordinary(r["text"] or "") and bytes(r["back"]) == (r["text"] or "").encode()
    assert none.select(bpe.encoder(RANKS, tok.PATTERN)("text").alias("ids")).count() == 0


def test_bpe_segments_of_huge_texts(spark, odd, none):
    rng = random.Random(8)
    alphabet = ["a", "B", "é", "日", "1", " ", "  ", "\n", " \n ", "'s", "'", "!", "the", " word"]
    texts = ["".join(rng.choices(alphabet, k=k)) for k in (0, 20, 60, 61, 64, 500, 5000)] + ["x" * 300, "ab " * 50 + " " * 200 + "cd" * 40, None, "y" * 70 + " the word" * 40]
    docs = spark.createDataFrame([(i, t, {"a": i}) for i, t in enumerate(texts)] * 2 + [(None, "the " * 100, None)], "doc_id long, text string, ids map<string,long>")
    extra = docs.withColumnRenamed("ids", "more")
    for segment, shared in ((64, 16), (50, 12)):
        rows = bpe.encode(extra, RANKS, tok.PATTERN, decoded="back", segment=segment, shared=shared).collect()
        assert len(rows) == 2 * len(texts) + 1
        for r in rows:
            assert bytes(r["back"]) == (r["text"] or "").encode()
            assert r["ids"] == _library.encode_ordinary(r["text"] or "") and (r["doc_id"] is None or r["more"] == {"a": r["doc_id"]})
    assert bpe.encode(docs, RANKS, tok.PATTERN).columns == ["doc_id", "text", "ids"]
    assert bpe.encode(docs, RANKS, tok.PATTERN, keep_text=False).columns == ["doc_id", "ids"]
    out = bpe.encode(odd, RANKS, tok.PATTERN, segment=1000, shared=100)
    assert out.columns == [*odd.columns, "ids"] and all(r["ids"] == _library.encode_ordinary(r["text"] or "") for r in out.collect())
    assert bpe.encode(none, RANKS, tok.PATTERN).count() == 0


def test_bpe_one_giant_text_takes_many_tasks(spark, frame):
    text = "".join(f"word{i} is here, and\n  so on " for i in range(40_000))
    assert bpe._segments(frame([text]).selectExpr("struct(doc_id) _row", "text _text", "'0' _rid"), bpe.SEGMENT, bpe.SHARED).selectExpr("input_file_name() f").distinct().count() > 1
    assert bpe.encode(frame([text]), RANKS, tok.PATTERN).collect()[0]["ids"] == _library.encode_ordinary(text)


def test_bpe_query(spark, documents):
    for r in queries.op3_bpe(spark, SF).collect():
        text = documents.text[r["doc_id"]]
        ids = _library.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


# fingerprints


def test_equal_substrings_share_names():
    rng = random.Random(2)
    draw = lambda n: bytes(rng.randrange(97, 123) for _ in range(n))
    middle = draw(4000)
    a, b, c = parsing.all_sketches([draw(37) + middle + draw(11), draw(501) + middle, draw(4000)])
    assert parsing.likeness(a, b) > 0.6 and parsing.likeness(a, c) < 0.1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab c"), max_size=60), max_size=6))
def test_sketch_depends_on_the_text_alone(texts):
    raw = [t.encode() for t in texts]
    assert [s.tolist() for s in parsing.all_sketches(raw)] == [parsing.sketches([r])[0].tolist() for r in raw]


@pytest.mark.parametrize("size", [128, 1024])
def test_no_size_parts_near_copies(size):
    """One more word changes a sketch as little across a size as below it."""
    rng = random.Random(size)
    alike = {0: [], 60: []}
    for _ in range(40):
        text = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(300))
        for below, found in alike.items():
            found.append(parsing.likeness(*parsing.all_sketches([text[: size - below - 3].encode(), (text[: size - below - 3] + " word").encode()])))
    assert np.mean(alike[0]) > np.mean(alike[60]) - 0.1 and min(alike[0]) > 0.5


def slow_sketch(data):
    """The same parsing, a symbol at a time."""
    mask, g = 2**64 - 1, 0x9E3779B97F4A7C15

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    def toss(own, before):
        place = ((own ^ before) & -(own ^ before)).bit_length() - 1
        return place * 2 + (own >> place & 1)

    x, level, names = [mix(b + 1) for b in data], 0, set()
    while x:
        if level >= parsing.FIRST or len(x) == 1:
            names |= {mix(s ^ 0xD6E8FEB86659FD93) >> 32 for s in x}
        if len(x) == 1:
            break
        runs = [(s, len(list(same))) for s, same in itertools.groupby(x)]
        x = [s if n == 1 else mix((s + n * g) & mask) for s, n in runs]
        label = [toss(s, x[i - 1] if i else s ^ mask) for i, s in enumerate(x)]
        for _ in range(parsing.TOSSES - 1):
            label = [toss(s, label[i - 1] if i else s ^ 1) for i, s in enumerate(label)]
        starts = [0] + [i for i in range(2, len(x) - 1) if label[i] > label[i - 1] and label[i] >= label[i + 1]]
        x = [mix(sum(mix((s + (j + 1) * g) & mask) for j, s in enumerate(x[a:b])) & mask) for a, b in zip(starts, [*starts[1:], len(x)])]
        level += 1
    return sorted(names)[: parsing.SKETCH]


@settings(max_examples=120, deadline=None)
@given(st.text(st.sampled_from("aab cdé"), max_size=300) | st.text(max_size=60))
def test_sketch_matches_a_slow_parser(text):
    data = text.encode("utf-8", "replace")
    assert parsing.sketches([data])[0].tolist() == slow_sketch(data)


def test_sketch_of_prose_matches_a_slow_parser(documents):
    for text in [t for t in documents.text if 1000 < len(t) < 4000][:4]:
        assert parsing.sketches([text.encode()])[0].tolist() == slow_sketch(text.encode())


def test_likeness_has_no_step():
    """A text is about as like its first 99 % at every length, on the mean of many texts; a step would show between neighbouring lengths."""
    rng = random.Random(7)
    texts = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(800)).encode() for _ in range(24)]
    mean = []
    for n in (64, 96, 120, 128, 136, 192, 256, 384, 512, 768, 1000, 1024, 1048, 1536, 2048, 3000, 4096):
        whole, part = parsing.all_sketches([t[:n] for t in texts]), parsing.all_sketches([t[: n * 99 // 100] for t in texts])
        mean.append(np.mean([parsing.likeness(a, b) for a, b in zip(whole, part)]))
    assert min(mean) > 0.5 and np.abs(np.diff(mean)).max() < 0.2


def test_neighbours(spark, documents):
    got = parsing.compare_neighbours(spark.read.parquet(f"{SF}/documents.parquet")).toPandas().set_index("id")
    docs = documents.sort_index(ascending=False)
    texts = docs.text.tolist()
    for k, i in enumerate(docs.index):
        follow, text = texts[(k + 1) % len(texts)], texts[k]
        edited = text[: len(text) - len(text) // 2] + follow[: len(text) // 2]
        assert got.edited_sha256[i] == hashlib.sha256(edited.encode()).hexdigest() and got.n_chars[i] == len(text)
        mine, other = parsing.all_sketches([text.encode(), edited.encode()])
        assert got.fingerprint[i] == parsing.text_of(mine) and got.near_edited[i] == parsing.likeness(mine, other)
    assert (got.near_edited > got.near_next).mean() > 0.95


def test_neighbours_odd_rows(spark, odd, none):
    got = parsing.compare_neighbours(odd).collect()
    assert len(got) == odd.count() and {r["fingerprint"] for r in got if r["id"] in (2, 3)} == {""}
    assert len({r["fingerprint"] for r in got if r["id"] in (1, 6)}) == 1
    one = parsing.compare_neighbours(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    assert parsing.compare_neighbours(none).count() == 0


# language ID


def test_language_of_held_out_rows(spark, documents):
    got = {r["doc_id"]: r for r in queries.op10_language_id(spark, SF).collect()}
    held = [i for i in documents.index if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] for i in held)
    assert np.mean([got[i]["lang_pred"] == documents.lang[i] for i in held]) > 0.97


def test_mixtures_are_found(frame):
    a, b = "alpha beta gamma delta epsilon zeta", "uno dos tres cuatro cinco seis"
    train = frame([a] * 4).union(frame([b] * 4, "es"))
    got = language.identify(frame([a, b, f"{a} {a} {a} {b} {b}"], None), train).orderBy("doc_id").collect()
    assert [r["language"]["lang_pred"] for r in got] == ["en", "es", "en"]
    assert got[2]["language"]["languages"] == ["en", "es"] and got[2]["language"]["shares"][1] == pytest.approx(0.4, abs=0.05)


def slow_mixture(words):
    """Shares and the selected set of one document by plain expectation-maximisation."""
    like = [[np.exp(float(x) - max(map(float, w))) for x in w] for w in words]
    k, n = len(words[0]), len(words)

    def em(shares, rounds):
        for _ in range(rounds):
            new = [0.0] * k
            for row in like:
                total = sum(x * s for x, s in zip(row, shares))
                for j in range(k):
                    new[j] += row[j] * shares[j] / total / n
            shares = new
        return shares, sum(np.log(sum(x * s for x, s in zip(row, shares))) for row in like)

    shares, _ = em([1 / k] * k, language.ROUNDS)
    order = sorted(range(k), key=lambda j: -shares[j])
    chosen, best = {order[0]}, sum(np.log(row[order[0]]) for row in like)
    for m in range(2, k + 1):
        part = [shares[j] + 1e-6 if j in order[:m] else 0.0 for j in range(k)]
        _, fit = em([p / sum(part) for p in part], 3)
        if (gain := fit - (m - 1) * language.PENALTY * np.log(max(n, 2))) > best:
            best, chosen = gain, set(order[:m])
    return shares, chosen


def test_mixtures_match_plain_arithmetic():
    rng = np.random.default_rng(8)
    sizes = np.array([1, 2, 7, 30, 60, 25])
    sources = [rng.choice(3, n, p=p) for n, p in zip(sizes, ([1, 0, 0], [0.5, 0.5, 0], [0.3, 0.3, 0.4], [0.9, 0.1, 0], [0.6, 0, 0.4], [0, 1, 0]))]
    words = np.concatenate([rng.normal(-12, 2, (len(s), 3)) + 9 * np.eye(3)[s] for s in sources]).astype(np.float32)
    shares, chosen = language.mixtures(words, sizes)
    for i, (a, n) in enumerate(zip(np.cumsum(sizes) - sizes, sizes)):
        wanted, names = slow_mixture(words[a : a + n])
        assert np.allclose(shares[i], wanted, atol=1e-3) and set(np.flatnonzero(chosen[i])) == names


def test_language_odd_rows(odd, none):
    got = {r["doc_id"]: r["language"] for r in language.identify(odd, odd).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (2, 3, 4, 7, 9)) and got[5]["lang_pred"] == "en"
    assert {r["language"]["lang_pred"] for r in language.identify(odd, none).collect()} == {"und"}
    assert language.identify(none, none).count() == 0


# packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=60))
def test_windows_hold(sizes):
    found = packing.windows(sizes, 64)
    assert len(found) == len(sizes) and (not sizes or np.bincount(found, weights=sizes).max() <= 64)


def test_differencing_is_near_equal():
    rng = random.Random(3)
    sizes = [rng.randint(1, 256) for _ in range(400)]
    sums = np.bincount(packing.difference(sizes, 50), weights=sizes)
    assert len(sums) == 50 and sums.max() - sums.min() <= 40


def check_packing(rows, texts):
    library = Tokenizer.from_file(JSON)
    for i, text in texts.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert sum(r["length"] for r in own) == len(ids)
        at = 0
        for r in own:
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 1024
    return sum(ends.values()) / (1024 * len(ends))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 64), st.booleans()), max_size=60))
def test_level_fills_windows_to_capacity(pieces):
    sizes, loose = [a for a, _ in pieces], [b for _, b in pieces]
    window = packing.windows(sizes, 64, 0)
    load, place = Counter(), Counter()
    out = packing.level(sizes, window, loose, 64)
    for i, start, length, w in sorted(out):
        assert start == place[i] and length > 0
        place[i] += length
        load[w] += length
    assert [place[i] for i in range(len(sizes))] == sizes
    assert max(load.values(), default=0) <= 64 and len(load) <= max(1, -(-sum(sizes) // 64))


def test_level_takes_from_loose_pieces_first():
    assert sorted(packing.level([50, 20, 40], [0, 0, 1], [False, True, False], 64)) == [(0, 0, 50, 0), (1, 0, 14, 0), (1, 14, 6, 1), (2, 0, 40, 1)]


def test_packing_query(spark, documents):
    rows = queries.op9_packing(spark, SF).collect()
    assert check_packing(rows, documents.text.to_dict()) > 0.99
    pieces = Counter(r["doc_id"] for r in rows if r["doc_tokens"] <= 1024)
    assert sum(n > 1 for n in pieces.values()) < 0.1 * len(pieces)


def test_packing_special_and_odd_rows(frame, odd, none):
    texts = ["a <|endoftext|> b", None, "", " ", "word " * 3000]
    check_packing(packing.pack(frame(texts), JSON, tok.PATTERN).collect(), dict(enumerate(texts)))
    out = packing.pack(odd, JSON, tok.PATTERN, with_ids=True)
    assert "length" in out.columns and out.columns.count("length") == 1
    assert all(len(r["ids"]) == r["length"] for r in out.collect())
    assert out.groupBy("doc_id").agg(F.sum("length")).count() == 10
    assert packing.pack(none, JSON, tok.PATTERN).count() == 0
