"""Operators 1 to 10 against brute force, and on awkward rows."""

import collections
import hashlib
import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewick.llm import decontaminate, fixity, html_text, licenses, line_dedup, mixing, near_dup, pii, quality_classifier, quality_rules, queries
from tidewick.llm import textnum as tn

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, dropped string, copies long"
AWKWARD = [
    (1, None, "en", "s1", None, "x", 7),
    (2, "", None, None, 0, "x", 7),
    (3, "word", "en", "s1", 4, None, None),
    (3, "word", "en", "s1", 4, None, None),
    (None, "a b c d e f g", "de", "s2", 13, "x", 1),
    (4, "a b c d e f g", "de", "s2", 13, "x", 1),
    (5, " \n\t \n", "fr", "s3", 5, "x", 1),
    (6, "lorem ipsum dolor sit amet " * 40_000, "en", "s1", 1_080_000, "x", 1),
    (7, "ünïcödé 日本語 \U0001f600 a@b.co +1 234 567 8901 4111111111111111", "ja", "s4", 60, "x", 1),
    (8, "x" * 300_000, "en", "s1", 300_000, "x", 1),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def shingle_set(text, n=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {" ".join(w)} if 0 < len(w) < n else {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute_components(rows, percent):
    sets = {d: shingle_set(t) for d, t in rows}
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    by = collections.defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    pairs = {(min(a, b), max(a, b)) for ds in by.values() for i, a in enumerate(ds) for b in ds[:i]}
    for a, b in pairs:
        i = len(sets[a] & sets[b])
        if 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {d: (len(s), top(d)) for d, s in sets.items()}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_equal_brute_force(spark, percent):
    rng = random.Random(percent)
    vocabulary = [f"w{i}" for i in range(500)]
    rows, common = [], " ".join(rng.choices(vocabulary, k=60))
    for g in range(40):
        base = rng.choices(vocabulary, k=rng.choice([4, 12, 60, 150, 700]))
        for _ in range(rng.choice([1, 2, 5, 30 if g % 10 == 0 else 3])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(w) + (" " + common if g % 4 == 0 else "")))
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()
    want = brute_components(rows, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_long_near_misses(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for n in (600, 900, 2500, 20_000):
        base, passage = rng.choices(vocabulary, k=n), rng.choices(vocabulary, k=n // 2)
        for share in (0.006, 0.009, 0.010, 0.011, 0.012, 0.013, 0.014, 0.020):  # each edit breaks five shingles: similarities around the threshold
            w = list(base)
            for i in rng.sample(range(n), int(share * n)):
                w[i] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(w)))
        for k in range(6):  # unlike texts around a shared passage
            rows.append((len(rows), " ".join(rng.choices(vocabulary, k=n // (4 + k)) + passage)))
    want = brute_components(rows, 80)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert 1 < len({c for _, c in want.values()}) < len(rows)


def test_near_duplicates_of_a_large_class_and_an_empty_table(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "HOT_CLASSES", 4)
    text = [" ".join(f"{k}w{i}" for i in range(30)) for k in range(9)]
    rows = [(i, text[0] if i % 3 == 0 else text[1] if i % 5 == 0 else text[i % 9]) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df).collect()} == brute_components(rows, 80)
    assert near_dup.near_duplicates(df.where("false")).count() == 0 and near_dup.drop_near_duplicates(df.where("false")).count() == 0


def test_near_duplicates_on_documents(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs, 85).collect()}
    assert got == brute_components(rows, 85)


def test_near_duplicates_awkward(awkward):
    got = near_dup.near_duplicates(awkward).collect()
    assert len(got) == len(AWKWARD)
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} >= {(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (None, 3, None, True), (4, 3, 4, True), (5, 0, 5, True)}


def test_drop_near_duplicates_keeps_one_of_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "b"), (1, text, "a"), (1, text, "b"), (2, text, "a"), (3, "other words", None), (3, "other words", None), (4, "one text", "x"), (4, "another text of it", "x"), (4, "", "x"), (4, "", "x")]
    rows += [(None, text, "n"), (None, text, "n"), (5, None, "n"), (5, None, "n"), (6, " \n", "n"), (6, " \n", "n"), (7, "alone", "z")]
    want = [(1, text, "a"), (3, "other words", None), *rows[6:]]
    for repartitioned in (1, 7):
        got = near_dup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(repartitioned))
        assert collections.Counter(map(tuple, got.collect())) == collections.Counter(want)
    only = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    assert collections.Counter(map(tuple, near_dup.drop_near_duplicates(only).collect())) == collections.Counter(x[:2] for x in want)


def base_brute(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    where = collections.defaultdict(list)
    for i in range(len(words) - 2):
        where[tuple(words[i : i + 3])].append(i)
    marked = {i + j for at in where.values() if len(at) > 1 for i in at for j in range(3)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(marked), n < 50 or 100 * len(marked) > 50 * n


def test_quality_rules(spark, docs, awkward):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    got = {r.doc_id: r for r in quality_rules.apply_quality_rules(docs, labels.where("quality = 1")).collect()}
    for r in docs.collect():
        x = got[r.doc_id]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == base_brute(r.text)
        assert x.kept == (not x.base_failed and x.score >= quality_rules.THRESHOLD)
    odd = quality_rules.apply_quality_rules(awkward, awkward.where("doc_id = 4")).collect()
    assert sorted((r.n_words, r.word_chars) for r in odd) == sorted(base_brute(t)[:2] for _, t, *_ in AWKWARD)
    assert all(r.score == 0 for r in quality_rules.apply_quality_rules(awkward, awkward.where("false")).collect())


def test_quality_rules_of_an_empty_table_and_clashing_columns(spark, awkward):
    assert quality_rules.apply_quality_rules(awkward.where("false"), awkward.select("doc_id")).count() == 0
    clash = awkward.withColumn("score", F.lit("x")).withColumn("kept", F.lit(1)).withColumn("trusted", F.lit(2))
    assert quality_rules.apply_quality_rules(clash, clash.select("doc_id", "kept")).count() == len(AWKWARD)


def test_quality_rules_score_is_the_mean_log_ratio(spark):
    rows = [(i, " ".join(f"good{(i * 7 + j) % 30}" for j in range(80))) for i in range(10)] + [(10 + i, " ".join(f"bad{(i * 5 + j) % 30}" for j in range(80))) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality_rules.apply_quality_rules(df, df.where("doc_id < 5")).collect()}
    raw, target = collections.Counter(), collections.Counter()
    ids = {d: quality_rules.features(tn.hashed_words(np.frombuffer(t.encode(), np.uint8), fold=tn.ASIS), quality_rules.BUCKETS) for d, t in rows}
    for d, x in ids.items():
        raw.update(x.tolist())
        target.update(x.tolist() if d < 5 else [])
    k, share = quality_rules.PSEUDO, sum(target.values()) / sum(raw.values())
    for d, x in ids.items():
        assert got[d] == pytest.approx(np.mean([np.log(target[i] + k) - np.log(raw[i] * share + k) for i in x.tolist()]))
    assert min(got[d] for d in range(10)) > max(got[d] for d in range(10, 20))


def spans_brute(text):
    text = text or ""
    digits = lambda s: re.sub(r"\D", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in digits(m[0])][::-1]
        if 16 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]


def test_personal_data(docs, spark):
    rng = random.Random(5)
    made = ["".join(rng.choice("a1.@-+ 9%()2\n") for _ in range(rng.randrange(200))) for _ in range(400)]
    made += ["4111 1111 1111 1111 x 378282246310005 card", "IBAN DE89370400440532013000 ok", "a@b.c@d.ef%x@y.zz", "1.2.3.4.5.6.7.8 256.1.1.1 01.02.03.004", "call (743) 555-3824 now", "+1" + " " * 50 + "2345678"]
    extra = spark.createDataFrame(list(enumerate(made, 10**6)), "doc_id long, text string")
    both = docs.select("doc_id", "text").union(extra)
    got = {r.doc_id: r for r in pii.find_pii(both).collect()}
    for r in both.collect():
        base = spans_brute(r.text)
        x = got[r.doc_id]
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert x.base_sha256 == hashlib.sha256(text.encode()).hexdigest(), r.text
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(k == kind for k, _, _ in base) for kind in ("email", "ip", "card", "phone")]
        assert x.spans.startswith(text)
    by_text = {r.text: got[r.doc_id].spans for r in extra.collect()}
    assert "iban:5:27" in by_text["IBAN DE89370400440532013000 ok"] and "card_short" in by_text[made[400]] and "phone_local" in by_text["call (743) 555-3824 now"]


def extra(text, base=(), threshold=pii.THRESHOLD):
    return {x[:3] for x in pii.extra_spans(text, list(base), threshold)}


def test_bank_accounts_end_before_the_next_word():
    for account, after in (
        ("DE89370400440532013000", " BIC COBADEFFXXX"), ("DE89 3704 0044 0532 0130 00", " 2024 paid"), ("DE89370400440532013000", " EUR 250"), ("GB82 WEST 1234 5698 7654 32", ""), ("NO9386011117947", " SEPA"),
        ("DE89370400440532013000", " GB82WEST12345698765432"), ("DE89370400440532013000", " PLEASE PAY"), ("DE89 3704 0044 0532 0130 00", " BY MONDAY"), ("de89370400440532013000", " please pay"), ("gb82-west-1234-5698-7654-32", " thanks"),
    ):
        text = f"IBAN: {account}{after}"
        assert ("iban", 6, 6 + len(account)) in extra(text), text
    assert ("iban", 22, 44) in extra("IBAN RF12 ABCD EFGH K DE89370400440532013000") and ("iban", 29, 51) in extra("IBAN: DE89370400440532013000 GB82WEST12345698765432")
    assert extra("IBAN DE88370400440532013000 EUR 250") == set()


def test_context_words_stand_whole_and_near():
    card, key = "378282246310005", "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"
    assert extra(f"my card {card}") == {("card_short", 8, 23)} and extra(f"{card} (Visa)") == {("card_short", 0, 15)}
    assert extra(f"discard {card}") == extra(f"cardinal {card}") == extra(f"card {'x' * 50} {card}") == extra(card) == set()
    assert extra("hotel 743 555-3824") == set() and extra("tel. 743 555-3824") == {("phone_local", 5, 17)}
    assert extra(f'token = "{key}"') == {("secret", 9, 49)} and extra(f"API_KEY={key}") == {("secret", 8, 48)}
    assert extra(f"commit {key}") == extra("token = aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1") == extra("the password is internationalization of it") == set()


def test_scores_follow_check_and_context():
    assert pii.scored("iban", "DE89370400440532013000", 0, 22, True) == 0.8 and pii.scored("iban", "x", 0, 1, False) == 0.0
    for kind, (holds, fails) in pii.CHECK.items():
        near = f"{pii.CONTEXT[kind].pattern.split('(?:')[1].split('|')[0].replace('[ _-]?', ' ')} XX"
        at = (len(near) - 2, len(near))
        for check, change in ((True, holds), (False, fails)):
            assert pii.scored(kind, near, *at, check) == pytest.approx(min(1, max(0, pii.PRIOR[kind] + change + pii.NEAR)))
            assert pii.scored(kind, "some XX", 5, 7, check) == pytest.approx(min(1, max(0, pii.PRIOR[kind] + change)))


def extra_brute(text, base):
    """Every substring that begins and ends where a word does, against plain definitions; the longest of each start, kinds apart."""
    digits = lambda s: re.sub(r"\D", "", s)
    luhn = lambda s: (sum(map(int, s[::-1][::2])) + sum(sum(divmod(2 * int(x), 10)) for x in s[::-1][1::2])) % 10 == 0
    words = {
        "iban": "iban|bank|account|konto", "card_short": "card|visa|credit", "phone_local": "phone|tel|call|fax", "ssn": "ssn|social security", "secret": "tokens?|secret|password|api.key",
    }
    near = lambda kind, s, e: any(
        re.fullmatch(words[kind], w[0], re.I) for w in re.finditer(r"social security|api.key|[a-z]+", text, re.I) if s - 40 <= w.start() and w.end() <= s or e <= w.start() and w.end() <= e + 20
    )
    out = set()
    for s, e in ((s, e) for s in range(len(text)) for e in range(s + 1, min(len(text), s + 60) + 1)):
        t, before, after = text[s:e], text[s - 1 : s] or " ", text[e : e + 1] or " "
        if any(b <= s and e <= f for _, b, f in base):
            continue
        if re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", t) and not (before + after).strip():
            if len(t) == pii.IBAN_LENGTHS.get(t[:2]) and int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1:
                out.add(("iban", s, e))
        elif re.fullmatch(r"[0-9]{13,15}", t) and not (before + after).strip() and luhn(t) and near("card_short", s, e):
            out.add(("card_short", s, e))
        elif re.fullmatch(r"[0-9]{3} [0-9]{3}-[0-9]{4}", t) and not before.isdigit() and not after.isdigit() and near("phone_local", s, e):
            out.add(("phone_local", s, e))
        elif re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", t) and before not in "-0123456789" and after not in "-0123456789" and near("ssn", s, e):
            out.add(("ssn", s, e))
        elif re.fullmatch(r"[0-9a-f]{40}", t) and not (before + after).strip(' "') and near("secret", s, e):
            out.add(("secret", s, e))
    return out


def test_added_spans_equal_brute_force(spark):
    rng = random.Random(9)
    digit = lambda n: "".join(rng.choices(string.digits, k=n))

    def account():
        body = digit(18)
        return f"DE{98 - int(body + '131400') % 97:02d}{body}"

    make = (account, lambda: "DE" + digit(20), lambda: digit(15), lambda: "378282246310005", lambda: f"{digit(3)} {digit(3)}-{digit(4)}", lambda: f"{digit(3)}-{digit(2)}-{digit(4)}", lambda: "".join(rng.choices("0123456789abcdef", k=40)))
    texts = [
        " ; ".join(f"{rng.choice(['card', 'discard', 'tel', 'hotel', 'ssn', 'token', 'tokens of', 'iban', 'some', 'words', 'x' * 45])} {rng.choice(make)()}" for _ in range(rng.randrange(1, 5))) for _ in range(150)
    ]
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    found = collections.Counter()
    for i, t in enumerate(texts):
        base = spans_brute(t)
        spans = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in got[i].spans.split(",") if x)]
        assert set(spans[len(base) :]) == extra_brute(t, base), t
        assert len(got[i].scores.split(",")) == got[i].n_spans if got[i].n_spans else got[i].scores == ""
        found.update(k for k, _, _ in spans)
    assert min(found[k] for k in ("iban", "card_short", "phone_local", "ssn", "secret")) > 3


def test_personal_data_awkward(spark, awkward):
    got = pii.find_pii(awkward).collect()
    assert len(got) == len(AWKWARD) and {r.n_spans for r in got if r.doc_id in (1, 2, 3, 5, 6, 8)} == {0}
    assert next(r for r in got if r.doc_id == 7).spans.split(":")[0] == "email" and pii.find_pii(awkward.where("false")).count() == 0


def test_quality_classifier_holds_out_and_separates(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality_classifier.score_quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    import zlib

    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([(r.score >= 0.3) == bool(r.quality) for r in got]) > 0.95
    assert all(r.predicted == int(r.score >= 0.3) for r in got)


def test_quality_classifier_equals_a_plain_discriminant(spark, docs):
    import zlib

    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    got = {r.doc_id: r.score for r in quality_classifier.score_quality(docs, labels).collect()}
    texts = {r.doc_id: np.frombuffer((r.text or "").encode(), np.uint8) for r in docs.collect()}
    x = {d: np.array(quality_classifier.statistics(t)) for d, t in texts.items()}
    train = [(x[r.doc_id], r.quality) for r in labels.collect() if r.doc_id in x and r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 5]
    of = [np.array([v for v, q in train if q == c]) for c in (0, 1)]
    mean, cov = [v.mean(0) for v in of], [np.cov(v.T, bias=True) for v in of]
    pooled = sum(len(v) * c for v, c in zip(of, cov, strict=True)) / sum(map(len, of))
    prior = (len(of[1]) + 1) / (sum(map(len, of)) + 2)
    q = quality_classifier
    shrunk = [(1 - q.SHRINK_POOLED) * c + q.SHRINK_POOLED * pooled for c in cov]
    shrunk = [(1 - q.SHRINK_DIAGONAL) * c + q.SHRINK_DIAGONAL * np.diag(np.diag(c)) + 1e-4 * np.eye(len(c)) for c in shrunk]
    for d, v in x.items():
        density = [-0.5 * (v - m) @ np.linalg.inv(c) @ (v - m) - 0.5 * np.linalg.slogdet(c)[1] for m, c in zip(mean, shrunk, strict=True)]
        z = (density[1] - density[0]) / q.TEMPERATURE + np.log(prior / (1 - prior))
        assert got[d] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -60, 60))), abs=1e-9)


def test_quality_classifier_awkward(spark, awkward):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (99, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_classifier.score_quality(awkward, labels).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 for r in got)
    assert quality_classifier.score_quality(awkward.where("false"), labels).count() == 0
    assert quality_classifier.keep_good(awkward, labels).columns == awkward.columns


def test_line_dedup_awkward(spark):
    rows = [(1000 + i, f"shared line\nown {i}\n\n shared line ", "en", f"s{i}", 1, "x", 1) for i in range(12)] + AWKWARD
    rows += [(2000 + i, f"only one site\nmine {i}", "en", "s0", 1, "x", 1) for i in range(30)]
    got = {}
    for r in line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.doc_id, r)
    assert got[1000].text == "shared line\nown 0\n\n shared line " and got[1000].lines_removed == 0
    assert all(got[1000 + i].text == f"own {i}\n" and (got[1000 + i].line_count, got[1000 + i].lines_removed) == (3, 2) for i in range(1, 12))
    assert all(got[2000 + i].lines_removed == 0 for i in range(30))
    assert got[1].text is None and got[2].text == "" and got[5].text == " \n\t \n"


@pytest.mark.parametrize("hot", [4, 10_000])
def test_line_dedup_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT_LINES", hot)
    rng = random.Random(hot)
    rows = [(i, "\n".join(f"line {int(rng.expovariate(0.08))}" for _ in range(rng.randrange(6))), f"s{rng.randrange(25)}") for i in range(300)]
    rows += [(1000 + i, "hot line\nthe same", f"s{i % 40}") for i in range(200)]
    sites, keeper = collections.defaultdict(set), {}
    for d, t, s in rows:
        for x in t.split("\n"):
            sites[x].add(s)
            keeper[x] = min(d, keeper.get(x, d))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    assert got == {d: "\n".join(x for x in t.split("\n") if not x or len(sites[x]) < line_dedup.MIN_SITES or keeper[x] == d) for d, t, _ in rows}
    assert line_dedup.dedup_lines(df.where("false")).count() == 0


def test_mixing_meets_targets(spark, docs, awkward):
    cells = spark.createDataFrame([("a", "x", "p", 100.0), ("a", "y", "p", 300.0), ("b", "x", "q", 500.0), ("b", "y", "q", 100.0)], "source string, lang string, topic string, tokens double")
    targets = spark.createDataFrame([("source", "a", 0.5), ("source", "b", 0.5), ("lang", "x", 0.3), ("lang", "y", 0.7), ("topic", "p", 0.5), ("topic", "q", 0.5)], "dimension string, value string, share double")
    rows = mixing.rake(cells, targets, rounds=48).collect()
    for d, v, share in (("source", "a", 0.5), ("lang", "y", 0.7)):
        assert sum(r.weight for r in rows if r[d] == v) == pytest.approx(share, abs=1e-3)
    for one_task, rounds, near in ((True, mixing.MAX_ROUNDS, 1e-5), (False, 3, 2e-2)):  # given shares stand, the others divide the rest; repeated and null targets
        some = spark.createDataFrame([("source", "a", 0.4), ("source", "a", 0.4), ("lang", "y", 0.7), ("lang", "x", None), ("topic", "none", 0.5)], "dimension string, value string, share double")
        grid = [(a, b, c, float(n * n)) for n, (a, b, c) in enumerate(((a, b, c) for a in "abc" for b in "xy" for c in "pq"), 1)]
        rows = mixing.rake(spark.createDataFrame(grid, cells.schema), some, rounds, one_task).collect()
        tokens = {a: sum(n for x, _, _, n in grid if x == a) for a in "abc"}
        shares = {(d, v): sum(r.weight for r in rows if r[d] == v) for d, v in (("source", "a"), ("lang", "y"), ("source", "b"), ("source", "c"))}
        assert shares["source", "a"] == pytest.approx(0.4, abs=near) and shares["lang", "y"] == pytest.approx(0.7, abs=near)
        assert shares["source", "b"] / shares["source", "c"] == pytest.approx((tokens["b"] / tokens["c"]) ** mixing.TEMPER["source"], rel=near * 10)
    topics = spark.createDataFrame([(i, "w " * 50, "en", "s", "sport" if i % 2 else "law") for i in range(400)], "doc_id long, text string, lang string, source string, topic string")
    wish = spark.createDataFrame([("topic", "law", 0.9)], "dimension string, value string, share double")
    taken = mixing.mix_sources(topics, wish).groupBy("topic").agg({"copies": "sum"}).collect()
    assert {r.topic: r[1] for r in taken}["law"] == pytest.approx(0.9 * 200, abs=15) and len(taken) == 2
    got = mixing.mix_sources(awkward).collect()
    assert all(r.copies >= 1 and r.text for r in got)
    assert mixing.mix_sources(awkward.where("false")).count() == 0
    total, taken = docs.select(mixing.token_count().alias("t")).groupBy().sum().first()[0], sum(r.tokens * r.copies for r in mixing.mix_sources(docs).collect())
    assert taken == pytest.approx(total * mixing.KEEP_SHARE, rel=0.3)


def align_brute(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1][j + 1] = max(0, h[i][j] + (1 if a[i] == b[j] else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
    return max(map(max, h))


def test_decontamination(spark, awkward):
    rng = random.Random(3)
    for _ in range(50):
        a, b = (np.array([rng.randrange(6) for _ in range(rng.randrange(1, 20))], dtype=np.uint64) for _ in range(2))
        assert decontaminate.align(a, b)[0] == align_brute(a.tolist(), b.tolist())
    vocabulary = [f"t{i}" for i in range(3000)]
    items = [" ".join(rng.choices(vocabulary, k=40)) for _ in range(30)]
    rows, want = [], set()
    for i in range(200):
        w = rng.choices(vocabulary, k=rng.randrange(10, 400))
        if i % 4 == 0:
            k = i % 30
            leak = items[k].split()
            if i % 8 == 0:
                for j in range(5, 40, 9):
                    leak[j] = "edited"
            w[5:5] = leak
            want.add((i, k))
        rows.append((i, " ".join(w).upper() if i % 3 == 0 else ", ".join(w)))
    bench = spark.createDataFrame([*enumerate(items), (98, None), (99, "")], "item_id long, text string")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontaminate.find_leaks(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    left = decontaminate.clean_documents(df, bench)
    assert {r.doc_id for r in left.collect()} == {i for i, _ in rows} - {i for i, _ in want}
    assert decontaminate.clean_documents(awkward, bench).count() == len(AWKWARD)
    assert decontaminate.clean_documents(awkward, bench.where("false")).count() == len(AWKWARD)


def test_decontamination_blocks(spark, monkeypatch):
    bench = spark.createDataFrame([(i, " ".join(f"b{i}w{j}" for j in range(20))) for i in range(7)], "item_id long, text string")
    df = spark.createDataFrame([(i, f"start b{i}w0 " + " ".join(f"b{i}w{j}" for j in range(1, 20)) + " end") for i in range(7)], "doc_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 60)
    assert {(r.doc_id, r.item_id, r.score) for r in decontaminate.find_leaks(df, bench).collect()} == {(i, i, 1.0) for i in range(7)}


@pytest.mark.parametrize("verbatim", [False, True])
def test_decontamination_finds_edited_copies(spark, verbatim):
    rng = random.Random(11)
    item = [f"w{i}" for i in range(40)]
    rows = [(k, [f"new{i}" if i % k == k - 1 else x for i, x in enumerate(item)]) for k in (4, 5)]
    rows.append((2, [x for i, x in enumerate(item) for x in ([x, f"more{i}"] if i % 2 else [x])]))
    for i in range(200):
        gone = set(rng.sample(range(40), 8 + i % 5))
        rows.append((100 + i, [f"new{j}" if j in gone else x for j, x in enumerate(item)]))
    rows = [(d, ["before"] * rng.randrange(9) + w + ["after"] * 5) for d, w in rows] + ([(1, item)] if verbatim else [])
    number = {x: i for i, x in enumerate({x for _, w in rows for x in w})}
    code = lambda w: [number[x] for x in w]
    want = {(d, s) for d, w in rows if (s := align_brute(code(item), code(w)) / 40) >= 0.5}
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    assert {(r.doc_id, r.score) for r in decontaminate.find_leaks(df, bench).collect()} == want and {2, 4, 5} <= {d for d, _ in want}
    assert {r.doc_id for r in decontaminate.clean_documents(df, bench).collect()} == {d for d, _ in rows} - {d for d, _ in want}


def test_fixity_audit(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * (i % 7)) for i in range(9000)] + [(None, None, None), (17, "again", "x")]
    a = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert fixity.audit(a, a).count() == 0
    b = spark.createDataFrame([(i, u, (h or "") + "!" if i in (5, 4096, 8999) else h) for i, u, h in rows if i != 77], "page_id long, url string, html string")
    got = {r.record: r for r in fixity.audit(a, b).collect()}
    assert set(got) == {5, 77, 4096, 8999} and got[77].replica_hash is None and got[4096].begin == 0
    assert fixity.audit(a.where("false"), a.where("false")).count() == 0
    assert fixity.audit(a, a.where("false")).count() == len(rows)


def test_fixity_of_null_and_repeated_ids(spark):
    rows = [(None, f"u{i}", "x" * i) for i in range(300)] + [(None, "same", "y")] * 500 + [(7, "u", "a")] * 40 + [(7, "u", "b"), (8, None, None), (9, "u", "")]
    schema = "page_id long, url string, html string, record string, n long"
    a = spark.createDataFrame([(*r, "x", 1) for r in rows], schema)
    assert fixity.audit(a, a.repartition(3)).count() == 0
    b = spark.createDataFrame([(*r, "x", 1) for r in rows[1:300] + rows[:1] + rows[301:] + [(9, "u", "")]], schema)
    got = [(r.record, r.primary_n, r.replica_n) for r in fixity.audit(a, b).collect()]
    assert sorted(got, key=str) == [(9, 1, 2), (None, 500, 499)]
    changed = a.where("page_id = 7 and html = 'b'").unionByName(spark.createDataFrame([(100, "u", "long", "x", 1)], schema))
    longer = changed.withColumn("html", F.concat("html", F.lit("!!!")))
    assert {(r.record, r.begin, r.primary_hash == r.replica_hash) for r in fixity.audit(changed, longer).collect()} == {(7, 0, False), (100, len("WARC/1.0rnWARC-Type: responsernWARC-Target-URI: urnContent-Length: 1rnrnbrnrn"), False)}


def test_fixity_nodes_hold_ordered_ranges(spark):
    rows = spark.createDataFrame([(0, i, 1, 1, 10 + i, f"h{i}") for i in range(5)], "side int, place long, copy int, n long, size long, hash string")
    import hashlib as h

    (one, two) = fixity.tree(rows, levels=2, fan_out=4)
    got = {r.node: (r.size, r.hash) for r in one.collect()}
    assert got[0] == (46, h.sha256(b"0+10:1*h0,10+11:1*h1,21+12:1*h2,33+13:1*h3,").hexdigest()) and got[1] == (14, h.sha256(b"0+14:1*h4,").hexdigest())
    assert two.first().hash == h.sha256(f"0+46:1*{got[0][1]},46+14:1*{got[1][1]},".encode()).hexdigest()


def test_licenses(spark, docs, awkward):
    texts = [
        "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "x CC BY-NC 4.0 y cc by nc", "This work is licensed under the GNU General Public License, version 3.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "the license of a dog", None, "",
    ]
    extra = spark.createDataFrame(list(enumerate(texts, 10**6)), "doc_id long, text string")
    both = docs.select("doc_id", "text").union(extra)
    got = {r.doc_id: r for r in licenses.scan_licenses(both).collect()}
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for r in both.collect():
        w = pattern.findall((r.text or "").translate(LOWER))
        at, labels = [], set()
        for phrase, label in licenses.BASE:
            p = phrase.split()
            here = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            at += here
            labels |= {label} if here else set()
        x = got[r.doc_id]
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
        assert set(filter(None, x.base_labels.split(","))) <= set(x.labels.split(",")) and 0 <= x.score <= 1
    assert [got[10**6 + i].labels for i in range(8)] == ["mit", "apache-2", "cc-by-nc", "gpl,gpl-3", "mit", "", "", ""]
    assert licenses.scan_licenses(awkward).count() == len(AWKWARD)


def test_license_names_versions_and_identifiers():
    index = licenses.Index({}, 0)
    for text, labels in (
        ("GPL-3.0", "gpl,gpl-3"), ("SPDX-License-Identifier: MIT", "mit"), ("SPDX-License-Identifier: GPL-2.0-only", "gpl,gpl-2"), ("the BSD 3-Clause license", "bsd,bsd-3"), ("BSD-2-Clause", "bsd,bsd-2"),
        ("subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2"), ("Eclipse Public License 2.0", "epl-2"), ("SPDX-License-Identifier: Apache-2.0", "apache-2"), ("GNU General Public License, version 2", "gpl,gpl-2"),
        ("under the terms of the GNU Lesser General Public License", "lgpl"), ("a CC BY-SA work", "cc-by-sa"), ("the general public has a license", ""), ("version 3.0 of the clause", ""), ("an MIT student's license", ""),
        ("the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "gpl,gpl-3"),
        ("Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd,bsd-3"),
    ):
        assert index.scan(licenses.words_of(text))[4] == labels, text


def labels_brute(words):
    """Labels and best share by trying every start of every template."""
    labels, best = set(), 0.0
    find = lambda p: [i for i in range(len(words)) if words[i : i + len(p)] == p]
    for p, label in licenses.BASE:
        if find(p.split()):
            labels.add(label)
            best = 1.0
    held = set(words)
    for label, ws, must in licenses.templates():
        if sum(w in held for w in ws) < licenses.SHARE * len(ws) - 1e-9 or not all(find(m) for m in must):
            continue
        musts = [find(m) for m in must]
        for start in range(-len(ws), len(words) + 1):
            got = sum(any(0 <= start - d + q < len(words) and words[start - d + q] == w for d in range(licenses.SLACK + 1)) for q, w in enumerate(ws))
            if got >= licenses.SHARE * len(ws) - 1e-9 and all(any(start - licenses.SLACK <= p <= start + len(ws) + licenses.SLACK for p in ps) for ps in musts):
                labels |= licenses.families(label)
                best = max(best, got / len(ws))
    return ",".join(sorted(labels)), min(1.0, best)


def test_license_labels_equal_brute_force(spark, docs):
    rng = random.Random(4)
    every = licenses.templates()
    rows = [r.text for r in docs.select("text").collect()]
    for _ in range(300):
        _, ws, _ = rng.choice(every)
        w = list(ws)
        for _ in range(rng.randrange(0, 6)):
            i = rng.randrange(len(w) + 1)
            w[i : i + rng.randrange(2)] = rng.choice([[], ["other"], [rng.choice(rng.choice(every)[1])]])
        cut = rng.randrange(len(w) // 3 + 1)
        rows.append(" ".join(["some", "text"] * rng.randrange(4) + w[cut:] + rng.choice(every)[1][: rng.randrange(20)]))
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    for i, text in enumerate(rows):
        labels, share = labels_brute(licenses.words_of(text))
        assert (got[i].labels, got[i].score) == (labels, pytest.approx(share)), text
    assert licenses.scan_licenses(docs.where("false")).count() == 0


def test_licenses_in_shortened_notices(spark):
    short = "permission is hereby granted free of charge to any person obtaining a copy"
    other = "this program is free software you can redistribute it under the terms of the gnu general public license"
    rows = [(0, f"a b c {short} d e"), (1, f"{short} and so on {'x ' * 50} redistribution and use in source and binary forms with or without modification"), (2, "permission is hereby granted"), (3, other.replace("redistribute it", "redistribute it and or modify it"))]
    rows += [(10 + i, "words of other texts in the corpus") for i in range(20)]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].labels for i in range(4)] == ["mit", "bsd,mit", "", "gpl"] and got[0].score == pytest.approx(13 / 20) and got[3].score == 1
    assert all(got[10 + i].labels == "" for i in range(20))


def test_html(spark):
    page = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies on this site for you</div>
    <article><h1>A &amp; B</h1><p>One <b>two</b>&nbsp;three<br>four<p>Be.</p><script>if (a<b) {"</p>"}</script><!-- <p>no</p> --><p>Short</article>
    <section id="comments"><p>A reader said a long thing here that is surely more than twenty words because comments can be as long as any text on it.</p></section>
    <form><label>Mail</label><input></form><aside>See also</aside><footer>&copy; x <a href=y>z</a></footer></body></html>"""
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p>unclosed <div"), (5, "u", "a" * 200_000), (6, "u", "<article><p>" + "word " * 50_000)]
    got = {r.page_id: r for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == "A & B One two three four Be. Short"
    assert got[2].text == got[3].text == "" and got[6].n_chars == 50_000 * 5 - 1
    assert all(len(r.text) == r.n_chars for r in got.values())


def test_html_names_of_layout_and_subject():
    inner = "<h1>Title</h1><p>" + "word " * 60 + "<p>last words of it"
    want = "Title " + "word " * 60 + "last words of it"
    article, tree = f"<article>{inner}</article>", html_text.train()
    long = "<p>" + "reply " * 90
    for page in (
        f'<div class="site has-sidebar">{article}</div>', f'<div class="content-with-sidebar">{article}</div>', f'<article class="post category-social tag-share">{inner}</article>',
        f'<div class="right-sidebar"><main>{inner}</main><div class="sidebar">{long}</div></div>', f'<div class="layout no_banner"><div id="social-page">{article}</div></div>',
        f'<div class="right-sidebar">{article}</div><div class="sidebar"><article>{"<p>few of them"}</article></div>',
        f'{article}<section id="comments"><article class="comment-body">{long}</article><article>{long}</article></section><div class="site-footer">{long}</div>',
        f'<article>{inner.replace("<p>last", "<p><svg class=i /><math/>last")}</article>', f"<div><svg width='1'/></div>{article}<p class=ad><svg></svg>",
    ):
        assert html_text.main_text(page, tree) == want, page


def test_html_keeps_all_of_the_article():
    tree, p = html_text.train(), "<p>" + "word " * 30
    for part, text in (
        ('<section id="discussion"><p>on it</section>', "on it"), ('<div class="related-work"><p>of others</div>', "of others"), ('<div class="share-price">12 euro</div>', "12 euro"),
        ("<noscript><p>a picture of it</noscript>", "a picture of it"), ("<p>where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds", "where x=2 holds"), ('<p><a href="x">all of it a link</a>', "all of it a link"),
        ("<div hidden>more of it</div>", "more of it"), ('<ul><li><a href="a">one</a><li><a href="b">two</a></ul>', "one two"), ("<!-- left open <p>and on", "and on"), ('<div data-class="ad">kept</div>', "kept"),
        ('<div class="searchResults">found</div>', "found"), ('<p class="comment-on-the-text">remark', "remark"),
        ("<header>By N. N.</header>", ""), ('<div class="ad">buy</div>', ""), ('<div class="cookieNotice">we use</div>', ""), ('<section id="reader-comments"><p>me too</section>', ""), ("<aside>see</aside>", ""), ("<form>mail</form>", ""),
    ):
        page = f"<body><nav><a href=/>Home</a></nav><article><h1>Title</h1>{p}{part}{p if '<!--' not in part else ''}</article><footer>end</footer>"
        want = " ".join(f"Title {'word ' * 30}{text} {'word ' * 30 if '<!--' not in part else ''}".split())
        assert html_text.main_text(page, tree) == want, part


def test_html_without_an_article_is_decided_by_the_neighbours():
    tree = html_text.train()
    link = lambda x: f'<li><a href="/{x}">{x}</a>'
    prose = "<p>" + "word " * 50
    page = f"<body><div><ul>{link('home')}{link('news')}{link('shop')}</ul></div><div>Most read today</div><ul>{link('first')}{link('second')}</ul><h2>A heading of it</h2>{prose}<p>Short one.{prose}<p><a href=x>all of it linked text</a>{prose}"
    page += f"<ul>{link('more')}{link('other')}</ul><div>Take a look</div><ul>{link('last')}{link('end')}</ul>"
    words = " ".join(["word"] * 50)
    assert html_text.main_text(page, tree) == f"A heading of it {words} Short one. {words} all of it linked text {words}"
    found = html_text.blocks(page)
    blind = [x[0] for x, r in zip(found, html_text.rows_of(found), strict=True) if html_text.decide(tree, (*r[:3], 0, 0.0, 0, 0.0, *r[7:]))]
    assert " ".join(blind) != html_text.main_text(page, tree)
    used = set()

    def walk(t):
        if not isinstance(t, int):
            used.add(t[0])
            walk(t[2])
            walk(t[3])

    walk(tree)
    assert {2} <= used and used & {3, 5} and used & {4, 6}  # link density, and words and density of neighbours
    table = np.array(html_text.labelled())
    assert all(html_text.decide(tree, r[:-1]) == r[-1] for r in table)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_html_pages_equal_a_parser_of_the_contract(spark, sf):
    from html.parser import HTMLParser

    class Article(HTMLParser):
        """The text of the article, cut at block tags."""

        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.parts = 0, []

        def handle_starttag(self, tag, attributes):
            self.inside += tag == "article"
            self.parts.append(" " if self.inside and tag not in ("b", "i", "a", "em") else "")

        def handle_endtag(self, tag):
            self.parts.append(" " if self.inside and tag not in ("b", "i", "a", "em") else "")
            self.inside -= tag == "article"

        def handle_data(self, data):
            self.parts.append(data if self.inside else "")

    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in html_text.extract_text(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        a = Article()
        a.feed(r.html)
        text = " ".join("".join(a.parts).split())
        assert got[r.page_id] == (r.url, text, len(text))


def test_html_awkward(spark):
    rows = [(1, None, None, "t", 5), (1, None, None, "t", 5), (None, "u", "<article>x", None, None), (2, "u", "<" * 1000, "t", 1), (3, "u", "<article>" * 3000 + "deep", "t", 1), (4, "u", "<p " + "a=b " * 50_000 + ">x", "t", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = html_text.extract_text(df).collect()
    assert sorted((str(r.page_id), r.text) for r in got if r.page_id not in (2, 4)) == [("1", ""), ("1", ""), ("3", "deep"), ("None", "x")]
    assert html_text.extract_text(df.where("false")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).columns == docs.columns
    assert corpus_pipeline.run(spark, d).count() > 0


def test_queries_import():
    assert {n.split("_")[0] for n in queries.QUERIES} == {"pipeline", *(f"op{i}" for i in range(1, 14))}
