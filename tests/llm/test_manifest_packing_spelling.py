"""Operators 11 to 13 against brute force, and on awkward rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from tidewick.llm import manifest, packing, queries, spelling, tokens
from tests.llm.test_operators import AWKWARD, SCHEMA

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


# --- spelling variants


def low(w):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows, rate=199, least=6):
    n = collections.Counter()
    for d, t in rows:
        for m in re.finditer("[A-Za-zÀ-ÿ]+", t or ""):
            w = low(m[0])
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % rate == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                n[w] += 1
    return n


def brute_variants(rows, rate=199, least=6, min_count=5, ratio=5):
    n = {w: k for w, k in brute_words(rows, rate, least).items() if k >= min_count}
    by_length = collections.defaultdict(list)
    for w in n:
        by_length[len(w)].append(w)
    form, count = {}, {}
    for w in n:
        around = [x for k in (-1, 0, 1) for x in by_length[len(w) + k] if x != w and near(w, x)]
        count[w] = len(around)
        best = min(around, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], count[w], n[form[w]] if form[w] else None) for w in n}


def variants(df, **more):
    out = spelling.spelling_variants(df, **more).collect()
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in out}
    assert len(found) == len(out)
    return found


def test_spelling_variants_equal_brute_force_on_documents(docs):
    assert variants(docs) == brute_variants([(r.doc_id, r.text) for r in docs.collect()])


def test_spelling_variants_of_edited_words(spark):
    """Words of 2 to 40 letters with chains of edits, at every place, double letters among them; one run in seven loses a letter."""
    rng = random.Random(4)
    letters = "aabbcéÿ×Z"
    rows = []
    for d in range(60):
        base = ["".join(rng.choice(letters) for _ in range(rng.choice([2, 6, 7, 9, 12, 40]))) for _ in range(4)]
        words = []
        for w in base:
            for k in range(4):
                words += [w] * 6 ** (3 - k)
                i, c = rng.randrange(len(w) + 1), rng.choice(letters)
                w = rng.choice([w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]])
        rows.append((d if d else None, rng.choice([" ", "-", "1", "中"]).join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for rate in (7, 199):
        want = brute_variants(rows, rate=rate)
        assert variants(df, rate=rate) == want
    assert max(len(w) for w in want) >= 40 and any(f and r != f for f, r, *_ in want.values())


def test_words_that_share_frequent_grams_are_found(spark):
    """Many words of one frequent beginning and end."""
    rng = random.Random(1)
    words = ["tion" + "".join(rng.choice("ab") for _ in range(8)) + "ment" for _ in range(150)]
    rows = [(d, " ".join(words)) for d in range(6)]
    assert variants(spark.createDataFrame(rows, "doc_id long, text string")) == brute_variants(rows)


def test_spelling_awkward(spark, awkward, monkeypatch):
    rows = [(r[0], r[1]) for r in AWKWARD]
    assert variants(awkward, min_count=1) == brute_variants(rows, min_count=1)
    monkeypatch.setattr(spelling, "BLOCK", 1000)  # long texts in many blocks
    text = " ".join(f"wörd{i % 7:x}abc" for i in range(900)) + "x" * 5000
    got = collections.Counter()
    for data, at, i, j in spelling.blocks(pa.array([text, None, "", "abcdefgh"])):
        got.update(spelling.block_words(data, at, [1, 2, 3, None][i:j], 199, 6).to_pylist())
    assert got == brute_words([(1, text), (None, "abcdefgh")])
    assert variants(awkward.limit(0)) == {}
    assert spelling.spelling_variants(awkward.limit(0)).columns == ["word", "form", "root", "n", "n_near", "form_n"]


# --- manifest


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf_of(r, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def climb(nodes, at):
    """Siblings (with the place among them) of a node up to the last one, and that one."""
    path = []
    while len(nodes) > 1:
        run = nodes[at // 8 * 8 : at // 8 * 8 + 8]
        path.append((at % 8, run[: at % 8] + run[at % 8 + 1 :]))
        nodes = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        at //= 8
    return path, nodes[0]


def brute_manifest(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"]), r))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for v in groups.values():
        v.sort(key=lambda x: x[:3])
    subroots = [climb([x[2] for x in groups[g]], 0)[1] for g in langs]
    out = []
    for k, g in enumerate(langs):
        top, root = climb(subroots, k)
        for i, (_, _, leaf, r) in enumerate(groups[g]):
            path = climb([x[2] for x in groups[g]], i)[0] + top
            text = r["text"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and text is not None:
                text = low(text)
            node = leaf_of(r, text)
            for place, others in path:
                node = sha("".join(others[:place]) + node + "".join(others[place:]))
            out.append((r["doc_id"], leaf, subroots[k], root, sha("".join("".join(o) for _, o in path)), node, node == root))
    return out


def proofs(df):
    from pyspark.sql import functions as F

    out = manifest.manifest(df).withColumn("proof", F.sha2("siblings", 256))
    return [tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified").collect()]


def same(a, b):
    return sorted(a, key=str) == sorted(b, key=str)


@pytest.mark.parametrize("sent", [0, 3, 4096])
def test_manifest_equals_brute_force(spark, docs, awkward, monkeypatch, sent):
    monkeypatch.setattr(manifest, "SENT_RUNS", sent)
    rows = [r.asDict() for r in docs.collect()]
    assert same(proofs(docs), brute_manifest(rows))
    rows = [r.asDict() for r in awkward.collect()]
    got = proofs(awkward)
    assert same(got, brute_manifest(rows)) and len(got) == len(AWKWARD)


@pytest.mark.parametrize("n,langs", [(1, 1), (7, 1), (8, 1), (9, 9), (65, 1), (90, 70), (600, 3)])
def test_manifest_of_many_shapes(spark, n, langs):
    rng = random.Random(n)
    rows = [{"doc_id": rng.randrange(n), "source": None, "lang": f"{'é' if i % 2 else 'z'}{i % langs}" if i % langs else None, "n_chars": i, "text": f"Text {i // 2}"} for i in range(n)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    got = proofs(df)
    assert same(got, brute_manifest(rows))
    assert {v for *_, v in got} == {zlib.crc32(str(d).encode()) % 3 != 0 for d, *_ in got}


def test_manifest_of_an_empty_table(awkward):
    assert proofs(awkward.limit(0)) == []


# --- packing


def ids_of(texts):
    encoder = tokens.Encoder(open(FILE, encoding="utf-8").read())
    assert encoder.merge is not None
    return [x.tolist() for _, part in encoder.encode(pa.array(texts, pa.string())) for x in part], encoder.whole


def test_ids_equal_the_library(docs):
    rng = random.Random(3)
    bits = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", "\r\n", "a", "Z", "é", "ß", "×", "÷", "1", "22", "²", "½", "ª", "\xa0", "\x85", "…", " ", "“", "’", "€", " ", "\x1c", "!", "_"]
    far = ["<|endoftext|>", "漢", "ж", "😀", "ʰ", "ɏ", "ɐ", "™", "ⁿ", "　", "́"]
    texts = ["".join(rng.choice(bits + far * k) for _ in range(rng.randint(0, 25))) for k in (0, 1) for _ in range(4000)]
    texts += [r.text for r in docs.collect()] + ["x" * 3000, " " * 3000, "", None]
    got, library = ids_of(texts)
    want = [e.ids for e in library.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    assert got == want


def test_other_files_go_to_the_library():
    encoder = tokens.Encoder(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    texts = ["Hello there", "", "x 1"]
    got = [x.tolist() for _, part in encoder.encode(pa.array(texts)) for x in part]
    assert encoder.merge is None and got == [e.ids for e in encoder.whole.encode_batch(texts, add_special_tokens=False)]


def test_blocks_of_texts_give_the_same_ids(docs, monkeypatch):
    texts = [r.text for r in docs.limit(60).collect()]
    whole = ids_of(texts)[0]
    monkeypatch.setattr(tokens, "BLOCK", 2000)
    assert ids_of(texts)[0] == whole


def check_packing(rows, texts, size):
    """Pieces cover every document's ids, and sequences have no gap and no overlap."""
    library = tokens.Encoder(open(FILE, encoding="utf-8").read()).whole
    want = collections.Counter()
    for d, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        first = len(ids) if len(ids) <= size else len(ids) % size or size
        cuts = [0, *range(first, len(ids) + 1, size)]
        want.update((d, k, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())) for k, (a, z) in enumerate(zip(cuts, cuts[1:])))
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    filled = collections.defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= size
    return len(filled), -(-sum(n for p in filled.values() for _, n in p) // size)


def test_packing_query(spark, sf, docs):
    n, least = check_packing(queries.op13_best_fit_packing(spark, sf).collect(), [(r.doc_id, r.text) for r in docs.collect()], packing.SIZE)
    assert n <= least + 1


@pytest.mark.parametrize("shard_tokens", [1 << 20, 20_000])
def test_packing_awkward_and_in_shards(spark, docs, awkward, shard_tokens):
    from pyspark.sql import functions as F

    for df in (docs.select("doc_id", "text"), awkward):
        x = packing.token_pieces(df, FILE, 512).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
        rows = packing.pack(x, 512, shard_tokens).collect()
        n, least = check_packing(rows, [(r.doc_id, r.text) for r in df.collect()], 512)
        assert n <= 1.01 * least + 2
    assert packing.pack(packing.token_pieces(awkward.limit(0), FILE)).collect() == []


def test_sequences_hold_the_ids(spark, docs):
    df = docs.limit(40)
    out = packing.sequences(df, FILE).collect()
    library = tokens.Encoder(open(FILE, encoding="utf-8").read()).whole
    got = np.concatenate([np.frombuffer(bytes(r.ids), "<u4") for r in out])
    assert sum(r.n_tokens for r in out) == len(got) and all(len(r.ids) == 4 * r.n_tokens for r in out)
    want = [i for r in df.collect() for i in library.encode(r.text, add_special_tokens=False).ids + [0]]
    assert collections.Counter(got.tolist()) == collections.Counter(want)


def test_sums_of_squares_takes_the_smallest_sum():
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 40, 300)
    where, offset, gaps = packing.sums_of_squares(lengths, 40)
    open_gaps: dict[int, int] = {}
    for i in np.argsort(-lengths, kind="stable"):
        k, s = int(where[i]), int(lengths[i])
        count = collections.Counter(g for g in open_gaps.values() if g)

        def total(gap):
            c = count.copy()
            c[gap] -= 1
            if gap > s:
                c[gap - s] += 1
            return sum(v * v for v in c.values())

        fits = {g: total(g) for g in count if g >= s}
        if k in open_gaps:
            assert total(open_gaps[k]) == min(fits.values())
        else:
            assert not fits
        assert offset[i] == 40 - open_gaps.get(k, 40)
        open_gaps[k] = open_gaps.get(k, 40) - s
    assert [open_gaps[k] for k in range(len(gaps))] == gaps.tolist()


def test_uniform_pieces_end_after_one_round(spark):
    """Pieces of which no two fit together: another round would not help."""
    df = spark.range(500).selectExpr("id", "60L as length")
    rows = packing.pack(df, 100, 1000).collect()
    assert len({r.sequence_id for r in rows}) == 500 and {r.offset for r in rows} == {0}
