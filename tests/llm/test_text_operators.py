"""Secrets, licenses, quality rules, and packing and files of token ids, against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import string
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arbora.llm import common, licenses, packing, planes, quality, secrets, tokens

ROOT = Path(__file__).resolve().parent.parent.parent
TOKENIZER = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
ODD = [None, "", " ", "\n\n", "a", "word " * 3000, "x" * 50_000, "é😀 字 <|endoftext|> \0 b", "a\r\n\tb  c"]


def frame(spark, texts, extra=True):
    rows = [(k if k % 7 else None, t, "s", k) for k, t in enumerate(texts)] if extra else [(k, t, "s", k) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, row int")


# Secrets


def base_by_hand(text):
    text = text or ""
    found = []
    for k, (pattern, flags, group, least) in enumerate(((r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A, 2, 12), (r"AKIA[A-Z0-9]+", 0, 0, 18), (r"[0-9a-f]+", 0, 0, 16))):
        found += [(m.start(), k, m.end()) for m in re.finditer(pattern, text, flags) if len(m[group]) >= least]
    return sorted(found)


def test_base_spans(spark, sf_dir):
    random.seed(1)
    pieces = ["password", "Passwd", "SECRET", "token", "api_key", "ApiKey", ":", "=", " ", '"', "'", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "deadbeef", "é", "😀", "\n", "xyz._-", "ſecret", "toKen"]
    texts = ["".join(random.choices(pieces, k=random.randint(1, 25))) for _ in range(400)] + ODD
    texts += [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    made = frame(spark, texts, extra=False)
    got = {r["doc_id"]: r for r in secrets.digest(made).collect()}
    for k, text in enumerate(texts):
        base = base_by_hand(text)
        said = ",".join(f"{['assign', 'access', 'hex'][n]}:{a}:{b}" for a, n, b in base)
        counts = Counter(n for _, n, _ in base)
        assert (got[k]["n_assign"], got[k]["n_access"], got[k]["n_hex"]) == (counts[0], counts[1], counts[2])
        assert got[k]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [x for x in got[k]["spans"].split(",") if x and not x.startswith("random")] == [x for x in said.split(",") if x]


def test_random_strings_are_found(spark):
    random.seed(2)
    alphabet = string.ascii_letters + string.digits
    plain = ["thentionwordsareherelong" * 2, "/usr/local/Share/Applications/Editor2", "snake_case_Name_of_some_Function_2", "ThisIsQuiteALongCamelCaseIdentifierName4", "AAAAAAAAAAAAAAAAAAAAAAAA1", "aB1" * 12]
    keys = ["".join(random.choices(alphabet, k=n)) for n in (24, 32, 40, 64)]
    texts = [f"some {x} here" for x in plain + keys]
    got = [r["n_random"] for r in secrets.digest(frame(spark, texts, extra=False)).orderBy("doc_id").collect()]
    assert got == [0] * len(plain) + [1] * len(keys)


def strengths(make, n=300):
    """The strength with which nine in ten of n keys are found whole."""
    found = []
    for _ in range(n):
        text, key = make()
        a = text.index(key)
        found.append(max((s for x, y, s in secrets.scan_text(text)[1] if x <= a and y >= a + len(key)), default=0.0))
    return float(np.quantile(found, 0.1))


def drawn(alphabet, n, before="", after=""):
    def make():
        key = "".join(random.choices(alphabet, k=n))
        return before + key + after, key

    return make


def test_opaque_parts_and_short_runs(spark):
    random.seed(12)
    alphabet = string.ascii_letters + string.digits
    assert strengths(drawn(alphabet, 32, "users/reset-password/confirm/")) >= 4
    assert strengths(drawn(alphabet, 40, "static/user_files/", "/x")) >= 4
    assert strengths(drawn(alphabet + "-_", 48, "users/x/")) >= 4
    assert strengths(drawn(alphabet + "+/", 48, "sk-live_")) >= 4
    assert strengths(drawn(alphabet, 16)) >= 2
    assert strengths(drawn(string.ascii_lowercase, 64)) >= 4 and strengths(drawn(string.ascii_uppercase, 64)) >= 4
    keys = ["".join(random.choices(alphabet, k=32)) for _ in range(3)]
    plain = ["users/reset-password/confirm/internationalisation", "some_long-path/of_ordinary-words/written+here", "acknowledgements"]
    texts = [f"see users/reset-password/confirm/{keys[0]} now", f"see static/user_files/{keys[1]}/page now", f"see {keys[2]} now", *plain]
    got = [r["spans"] for r in secrets.digest(frame(spark, texts, extra=False)).orderBy("doc_id").collect()]
    assert got == [f"random:{t.index(k)}:{t.index(k) + 32}" for t, k in zip(texts, keys)] + [""] * len(plain)


def test_random_beside_base_spans(spark):
    random.seed(14)
    access, key, digits = "AKIA" + "".join(random.choices(string.ascii_uppercase + string.digits, k=16)), "".join(random.choices(string.ascii_letters + string.digits, k=40)), "".join(random.choices("0123456789abcdef", k=40))
    texts = [f"pair {access}/{key} here", f"pair {digits}/{key} here", f"pair {key}_{digits} here", f"only {digits} here"]
    made = frame(spark, texts, extra=False)
    for text, r in zip(texts, secrets.digest(made).orderBy("doc_id").collect(), strict=True):
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r["spans"].split(","))]
        base = {x for k, a, b in spans if k != "random" for x in range(a, b)}
        found = [x for k, a, b in spans if k == "random" for x in range(a, b)]
        assert not base & set(found) and len(found) == len(set(found))
        if key in text:
            at = text.index(key)
            assert set(range(at, at + 40)) <= base | set(found)
        else:
            assert r["n_random"] == 0
    clean = "".join(r["text"] for r in secrets.redact(made).collect())
    assert key not in clean and not re.search("[A-Za-z0-9]{12,}", clean)


def test_keys_of_one_case():
    random.seed(13)
    small, capital = string.ascii_lowercase, string.ascii_uppercase
    for alphabet in (small + string.digits, small + "234567", capital + "234567", capital + string.digits, small + capital):
        for n in (64, 128, 256):
            assert strengths(drawn(alphabet, n)) >= 4, (alphabet, n)
    assert secrets.encoding("q7w8e9r0t1y2u3") == "base36" and secrets.encoding("Q7W8E9R0T1Y2U3") == "base36 upper"
    assert secrets.encoding("qwertyuiop234567") == "base32 lower" and secrets.encoding("QWERTYUIOP234567") == "base32"
    for text in ("INTERNATIONALIZATION2", "internationalization2", "CHARACTERISTICS4OPERATION", "Characteristicsofoperation"):
        assert secrets.assess(text)[1] > 1e-3


def test_battery():
    random.seed(3)
    fine = [secrets.combined(secrets.tests([random.randrange(16) for _ in range(64)], 16)) for _ in range(400)]
    assert 0.02 < np.mean(np.array(fine) < 0.1) < 0.25
    assert secrets.combined(secrets.tests([0, 1] * 32, 16)) < 1e-6
    assert secrets.combined(secrets.tests(list(range(16)) * 4, 16)) < 1e-3
    assert secrets.encoding("deadbeef00112233") == "hex" and secrets.encoding("abcdefgh") is None


def threshold_by_hand(strengths, q=secrets.RATE):
    """Benjamini and Hochberg: the k-th least of m p-values is compared with q * k / m; p-values are rounded up to the histogram's steps."""
    steps = sorted((min(int(s / secrets.STEP), secrets.BINS) * secrets.STEP for s in strengths), reverse=True)
    passing = [s for k, s in enumerate(steps, 1) if 10**-s * len(steps) <= q * k]
    return min(passing, default=float("inf"))


def test_false_discovery_control_by_hand(spark, sf_dir):
    """What is reported is what Benjamini and Hochberg's procedure over the p-values of all opaque strings of all documents is."""
    random.seed(15)
    alphabet = string.ascii_letters + string.digits
    texts = [r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts += [f"x {''.join(random.choices(alphabet, k=n))} y" for n in (12, 14, 16, 18, 20, 24, 28, 32, 40, 48) for _ in range(6)]
    texts += [f"see {''.join(random.choice(['some', 'path', 'Of', 'Words', 'file', 'name_', 'Data', 'x2']) for _ in range(5))} now" for _ in range(200)]
    found = [secrets.scan_text(t)[1] for t in texts]
    least = threshold_by_hand([s for f in found for *_, s in f])
    assert 0 < least < 10
    got = {r["doc_id"]: r["spans"] for r in secrets.digest(frame(spark, texts, extra=False)).collect()}
    reported = 0
    for k, (text, f) in enumerate(zip(texts, found, strict=True)):
        base = base_by_hand(text)
        covered = {x for a, _, b in base for x in range(a, b)}
        want = {x for a, b, s in f if s >= least for x in range(a, b)} - covered
        spans = [x.split(":") for x in got[k].split(",") if x.startswith("random")]
        assert {x for _, a, b in spans for x in range(int(a), int(b))} == want, text
        reported += bool(spans)
    assert reported > 30


def test_the_battery_decides(spark):
    """Strings of the same letters, which letter frequencies can't tell apart: in random order they are found, sorted or alternating
    they aren't."""
    random.seed(16)
    alphabet = string.ascii_letters + string.digits
    texts = []
    for n in (32, 40, 48):
        for _ in range(4):
            key = random.choices(alphabet, k=n)
            place = secrets._PLACE["base62"]
            by_place = sorted(key, key=place.get)
            low, high = by_place[: n // 2], by_place[n // 2 :]
            turns = "".join(x for two in zip(low, random.sample(high, len(high)), strict=False) for x in two)
            texts += [f"a {''.join(key)} b", f"a {''.join(by_place)} b", f"a {turns} b"]
    got = [r["n_random"] > 0 for r in secrets.digest(frame(spark, texts, extra=False)).orderBy("doc_id").collect()]
    assert all(got[::3]) and not any(got[1::3]) and not any(got[2::3])


def test_p_of_text_by_hand():
    """Chi-squared's p-value under text, against all ways to fill the cells one after another; and the bound for long strings."""
    rng = random.Random(18)
    for name in secrets.ENCODINGS:
        share, even = secrets.text_cells(name)
        ends = secrets._TEXT_EDGES[name]
        far = lambda c: sum((x - sum(c) * e) ** 2 / (sum(c) * e) for x, e in zip(c, even))  # noqa: B023, E731
        for n in (12, 17, 25):
            symbols = [rng.randrange(ends[-1]) for _ in range(n)]
            seen = far([sum(a <= x < b for x in symbols) for a, b in zip(ends, ends[1:])])
            want = 0.0
            for a in range(n + 1):
                for b in range(n + 1 - a):
                    if far((a, b, n - a - b)) <= seen + 1e-9:
                        want += math.comb(n, a) * math.comb(n - a, b) * share[0] ** a * share[1] ** b * share[2] ** (n - a - b)
            assert math.isclose(secrets.p_of_text(symbols, name), min(1.0, want), rel_tol=1e-6)
        values, chances = secrets._text_tail(name, secrets.EXACT)
        for chi2 in (0.5, 2.0, 6.0, 40.0, 1000.0):
            exact = chances[np.searchsorted(values, chi2 + 1e-9) - 1]
            assert exact * 0.99 <= secrets._text_bound(name, secrets.EXACT, chi2) <= 1


def test_text_is_seldom_taken_for_random():
    """Of symbols drawn as text has them, a share of t at most has a p-value of t; of random ones of 24 and more most have 1e-5."""
    rng = random.Random(19)
    for name in ("base62", "base36", "hex", "base64url"):
        symbols = range(len(secrets._RANKED[name]))
        weights = [secrets._SHARES[name][c] for c in secrets._RANKED[name]]
        for n in (16, 32, 150):
            ps = np.array([secrets.p_of_text(rng.choices(symbols, weights, k=n), name) for _ in range(3000)])
            assert (ps <= 0.1).mean() < 0.12 and (ps <= 0.01).mean() < 0.016 and (ps <= 0.001).mean() < 0.004
    keys = lambda n: np.array([secrets.assess("".join(rng.choices(string.ascii_letters + string.digits, k=n)))[1] for _ in range(400)])
    assert (keys(24) <= 1e-5).mean() > 0.75 and (keys(32) <= 1e-5).mean() > 0.93 and (keys(48) <= 1e-8).mean() > 0.97


def test_secrets_in_long_texts_and_clashing_columns(spark):
    key = "".join(random.Random(17).choices(string.ascii_letters + string.digits, k=40))
    rows = [(1, "word " * 400_000 + key, "mine", 2.5), (2, key, None, None), (2, key, None, None)]
    made = spark.createDataFrame(rows, "doc_id long, text string, base string, random double")
    got = secrets.digest(made).orderBy("doc_id").collect()
    assert [r["spans"] for r in got] == ["random:2000000:2000040", "random:0:40", "random:0:40"]
    clean = secrets.redact(made).orderBy("doc_id").collect()
    assert [r["base"] for r in clean] == ["mine", None, None] and all(r["text"].endswith("[secret]") for r in clean)


def test_redaction(spark):
    made = spark.createDataFrame([(1, 'a token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" b', 3), (None, None, 4), (2, "0123456789abcdef0123456789abcdef", 5), (2, "0123456789abcdef0123456789abcdef", 5)], "doc_id long, text string, base int")
    got = sorted(((r["text"] or "", r["base"]) for r in secrets.redact(made).collect()))
    assert got == [("", 4), ("[secret]", 5), ("[secret]", 5), ('a [secret]" b', 3)]
    assert secrets.redact(made).columns == made.columns
    assert secrets.redact(made.limit(0)).count() == 0


def test_redaction_of_many_secrets(spark):
    """A text is cut in time in proportion to it."""
    text = " ".join(f"{k:016x}abcdef" for k in range(100_000))
    began = time.perf_counter()
    got = secrets.redact(spark.createDataFrame([(text, 1)], "text string, c0 int"))
    assert got.columns == ["text", "c0"] and got.first()["text"] == " ".join(["[secret]"] * 100_000)
    assert time.perf_counter() - began < 60
    assert secrets.cut("0123456789", [(5, 7), (1, 3), (2, 4), (4, 5)], "#") == "0#789" and secrets.cut("ab", [(0, 2)], "#") == "#"


def test_secrets_odd_rows(spark):
    made = frame(spark, ODD + ODD)
    assert secrets.digest(made).count() == 2 * len(ODD)
    assert secrets.digest(made.limit(0)).count() == 0


# Licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_by_hand(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def license_by_hand(text):
    words = words_by_hand(text)
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        at = [k for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_base(spark, sf_dir):
    random.seed(4)
    vocabulary = "gnu general public license apache mit cc by CC BY-NC MIT License. Apache  GNU x é , 2".split(" ")
    texts = [" ".join(random.choices(vocabulary, k=random.randint(0, 30))) for _ in range(200)] + ODD
    texts += [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    got = {r["doc_id"]: r for r in licenses.scan_digest(frame(spark, texts, extra=False)).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        r = got[k]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == license_by_hand(text), text
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
        assert 0.0 <= r["score"] <= 1.0


def test_license_diagonals(spark):
    notice = dict(reversed(licenses.NOTICES))["bsd"]
    words = notice.split()
    inserted = " ".join([*words[:8], "and", "also", *words[8:]])
    dropped = " ".join([*words[:8], *words[10:]])
    texts = [f"x y {notice} z", inserted, dropped, " ".join(words[:6]), " ".join(reversed(words))]
    got = licenses.scan(frame(spark, texts, extra=False)).orderBy("doc_id").collect()
    assert [r["labels"] for r in got] == ["bsd", "bsd", "bsd", "", ""]
    assert got[0]["score"] == 1.0 and got[0]["spans"][0]["first"] == 2 and got[0]["spans"][0]["last"] == 1 + len(words)
    assert 0.6 <= got[1]["score"] <= 1.0 and len(got[1]["spans"]) == 1


def finds_by_hand(text):
    """(first word, last word, label, share of the notice) of every notice, by comparing all its grams with all of the text's."""
    words, found = words_by_hand(text), []
    for x in licenses.templates():
        if x.base:
            continue
        hits: dict = {}
        for at in range(len(x.words) - x.gram + 1):
            for k in range(len(words) - x.gram + 1):
                if tuple(words[k : k + x.gram]) == x.words[at : at + x.gram]:
                    hits.setdefault(k - at, set()).add(at)
        runs: list[list[int]] = []
        for d in sorted(hits):
            if runs and d - runs[-1][-1] <= licenses.NEAR:
                runs[-1].append(d)
            else:
                runs.append([d])
        for run in runs:
            covered = {w for d in run for at in hits[d] for w in range(at, at + x.gram)}
            places = [d + at for d in run for at in hits[d]]
            if len(covered) / len(x.words) >= licenses.COVER:
                found.append((min(places), max(places) + x.gram - 1, x.label, round(len(covered) / len(x.words), 9)))
    return sorted(found)


def test_license_notices_by_hand(spark):
    random.seed(18)
    notices = [text for _, text in licenses.NOTICES]
    texts = []
    for _ in range(120):
        parts = []
        for _ in range(random.randint(1, 3)):
            words = random.choice(notices).split()
            a, b = sorted(random.sample(range(len(words) + 1), 2)) if random.random() < 0.4 else (0, len(words))
            words = words[a:b]
            for _ in range(random.randint(0, 3)):
                k = random.randrange(len(words) + 1)
                words[k : k + random.randint(0, 1)] = random.choices(["x", "and", "the"], k=random.randint(0, 2))
            parts += [*random.choices(["word", "license", "by"], k=random.randint(0, 5)), *words]
        texts.append(" ".join(parts))
    texts += ["cc by nc 4 " * 30, "licensed under cc by nc 4 0 " * 20]
    base = set(licenses.PHRASES.values())
    finds = 0
    for r in licenses.scan(frame(spark, texts, extra=False)).collect():
        want = finds_by_hand(texts[r["doc_id"]])
        got = sorted((s["first"], s["last"], s["label"], round(s["cover"], 9)) for s in r["spans"])
        phrases = [x for x in got if x not in want]
        assert [x for x in got if x in want] == want and all(x[3] == 1.0 and x[2] in base for x in phrases)
        assert len(phrases) == r["n_base"]
        assert set(r["labels"].split(",")) - {""} == {x[2] for x in got}
        assert r["score"] == pytest.approx(max((x[3] for x in got), default=0.0))
        finds += len(want)
    assert finds > 60


def test_license_long_texts(spark):
    texts = ["cc by " * 200_000, "some ordinary words here now " * 1_000_000, "x" * 3_000_000, "mit license " + "the quick brown fox " * 100_000]
    got = licenses.scan_digest(frame(spark, texts, extra=False)).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_base"], r["first_word"], r["last_word"]) for r in got] == [(400_000, 200_000, 0, 399_998), (5_000_000, 0, None, None), (1, 0, None, None), (400_002, 1, 0, 0)]


def test_license_repeated_rows_in_parts(spark, monkeypatch):
    monkeypatch.setattr(common, "REPEATS", 4)
    made = spark.createDataFrame([(1, "mit license", 5)] * 11 + [(None, None, 6)] * 9 + [(2, "x", 7)], "doc_id long, text string, rows int")
    got = Counter((r["doc_id"], r["n_base"], r["labels"]) for r in licenses.scan(made).collect())
    assert got == {(1, 1, "mit"): 11, (None, 0, ""): 9, (2, 0, ""): 1}


def test_license_odd_rows(spark):
    made = frame(spark, ["mit license"] * 3 + ODD + ODD)
    made = made.unionByName(made.where("doc_id = 1"))
    got = licenses.scan(made)
    assert got.count() == made.count()
    assert [r["n_base"] for r in got.where("doc_id = 1").collect()] == [1, 1]
    assert licenses.scan(made.limit(0)).count() == 0


# Quality


def quality_by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {j for k in range(len(words) - 4) if grams[tuple(words[k : k + 5])] > 1 for j in range(k, k + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_measures(spark):
    random.seed(5)
    texts = ["".join(random.choices(["a", "b ", "c\n", "é", " ", "\t", "#", "\x0b", "\xa0", "| ", "the end of it all "], k=random.randint(0, 120))) for _ in range(300)] + ODD
    got = {r["doc_id"]: r for r in quality.judge(frame(spark, texts, extra=False)).collect()}
    for k, text in enumerate(texts):
        n, chars, symbols, repeated, covered = want = quality_by_hand(text)
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, text
        assert r["base_failed"] == (n < 10 or 100 * covered > 20 * n)
        assert not (r["base_failed"] and r["kept"])


def test_ablations(spark, sf_dir):
    made = quality.ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")).cache()
    rows = made.select("failed").collect()
    m = quality.mask("v1")
    for r in quality.ablations(made, "v1").collect():
        bit = quality.mask([r["rule"]])
        assert r["rejected"] == sum(bool(x["failed"] & bit) for x in rows)
        assert r["rejected_alone"] == sum(x["failed"] & m == bit for x in rows)


def test_quality_odd_rows(spark):
    made = frame(spark, ODD + ODD).withColumn("n_words", F.lit("mine")).withColumn("failed", F.lit(None).cast("int"))
    kept = quality.keep(made)
    assert kept.columns == made.columns and kept.count() == 0
    assert quality.judge(made).count() == 2 * len(ODD)
    assert quality.keep(made.limit(0)).count() == 0
    clean = " ".join(f"word{k} and" for k in range(40))
    again = quality.keep(frame(spark, [clean, clean]).withColumn("n_words", F.lit("mine")))
    assert [r["n_words"] for r in again.collect()] == ["mine", "mine"]


# Token ids


def ids_of(texts):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(TOKENIZER)
    return [x.ids for x in known.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_encoder():
    random.seed(6)
    pieces = [" ", "\n", "a", "Bc", "1", "é", "\t", "\r", "'s", "<|endoftext|>", "<|", "!", "字", "😀", "\xa0", "\x1c", "\x85", " ", "​"]
    texts = ["".join(random.choices(pieces + ["\0"] * (k % 2), k=random.randint(0, 40))) for k in range(3000)] + ODD
    got = [x.tolist() for x in tokens.encoder(TOKENIZER).encode(pa.array(texts))]
    assert got == ids_of(texts)


def test_encoder_forgets(monkeypatch):
    """What an encoder remembers stays within its bytes over many batches of new words, and ids stay right."""
    monkeypatch.setattr(tokens, "CACHE_BYTES", 1_000_000)
    monkeypatch.setattr(tokens, "RECENT_UNITS", 3000)
    random.seed(19)
    codec, held = tokens.Encoder(TOKENIZER), []
    for _ in range(12):
        texts = [" ".join("".join(random.choices(string.ascii_lowercase, k=random.randint(2, 9))) for _ in range(400)) for _ in range(30)]
        assert [x.tolist() for x in codec.encode(pa.array(texts))] == ids_of(texts)
        assert [x.tolist() for x in codec.encode(pa.array(texts[:3]))] == ids_of(texts[:3])
        held.append(codec.known.held)
    assert max(held) < 2_000_000 and min(b - a for a, b in zip(held, held[1:], strict=False)) < 0


def test_workers_stay_small(spark):
    """A worker's memory, over batches of new words, by its own account."""
    import subprocess
    import sys

    code = f"""
import random, string
import pyarrow as pa
from arbora.llm import tokens
from arbora.llm.common import tidied
random.seed(1)
def batch():
    return pa.array([" ".join("".join(random.choices(string.ascii_lowercase, k=7)) for _ in range(200)) for _ in range(300)])
sizes = []
def work(batches):
    codec = tokens.encoder({TOKENIZER!r})
    for b in batches:
        yield sum(len(x) for x in codec.encode(b))
        sizes.append(int(open("/proc/self/status").read().split("VmRSS:")[1].split()[0]) // 1024)
assert len(list(tidied(work, encodes=True)(batch() for _ in range(30)))) == 30
assert tokens._encoders[{TOKENIZER!r}].known.held < 1.3 * tokens.CACHE_BYTES
list(tidied(iter)(iter([])))
assert not tokens._encoders
print(sizes[9], sizes[-1])
"""
    early, late = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=str(ROOT)).stdout.split())
    assert late - early < 120 and late < 450


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_packing(spark):
    random.seed(7)
    texts = [" ".join(random.choices(["alpha", "beta", "of", "the"], k=random.randint(0, 900))) for _ in range(60)] + [" ".join(["long"] * 9000)] + ODD
    made = frame(spark, texts, extra=False)
    rows = packing.pack(made, TOKENIZER, group_docs=20).withColumn("crc", F.crc32("ids")).collect()
    want = {k: [*ids, 1] for k, ids in enumerate(ids_of(texts))}
    pieces: dict = {}
    bins: dict = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["crc"], r["doc_tokens"]))
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert pieces.keys() == want.keys()
    for k, own in pieces.items():
        at = 0
        for start, length, found, n in sorted(own):
            assert start == at and n == len(want[k]) and found == crc(want[k][start : start + length])
            at += length
        assert at == len(want[k])
    padding = 0
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 0.05 * sum(map(len, want.values()))
    again = packing.pack(made.repartition(3), TOKENIZER, group_docs=20).collect()
    assert sorted(map(tuple, again)) == sorted(tuple(r)[:-1] for r in rows)


def test_first_fit_decreasing():
    random.seed(8)
    for _ in range(50):
        sizes = [random.randint(1, 100) for _ in range(random.randint(0, 80))]
        bins: list[list[int]] = []
        for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
            place = next((b for b in bins if sum(sizes[j] for j in b) + sizes[k] <= 100), None)
            if place is None:
                bins.append(place := [])
            place.append(k)
        assert packing.first_fit_decreasing(sizes, 100) == bins


def test_packing_repeated_rows(spark):
    """Rows that all fall into one group are packed in parts."""
    made = spark.createDataFrame([(None, "again and again")] * 300, "doc_id long, text string")
    rows = packing.pack(made, TOKENIZER, group_docs=20).collect()
    one = len(ids_of(["again and again"])[0]) + 1
    assert sum(r["length"] for r in rows) == 300 * one
    held: dict = {}
    for r in rows:
        held[r["sequence_id"]] = held.get(r["sequence_id"], 0) + r["length"]
    assert max(held.values()) <= 2048


def test_rows_that_repeat_often(spark, monkeypatch):
    """They are dealt to groups and shards by number, and none is lost."""
    monkeypatch.setattr(common, "REPEATS", 16)
    rows = [(None, None)] * 200 + [(7, "again and again")] * 150 + [(k, f"text {k}") for k in range(100, 140)]
    made = spark.createDataFrame([(*r, "mine", 1) for r in rows], "doc_id long, text string, copy string, times int").repartition(5)
    pieces = packing.pack(made, TOKENIZER, group_docs=32).collect()
    sizes = Counter()
    for r in pieces:
        sizes[r["doc_id"]] += r["length"]
    again = len(ids_of(["again and again"])[0]) + 1
    assert sizes[None] == 200 and sizes[7] == 150 * again
    assert len({r["sequence_id"] >> 32 for r in pieces if r["doc_id"] is None}) > 3
    same = packing.pack(made.repartition(2), TOKENIZER, group_docs=32).collect()
    assert Counter(map(tuple, same)) == Counter(map(tuple, pieces))
    got = planes.file_round_trip(made, TOKENIZER).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None] * 200 + [7] * 150 + list(range(100, 140))
    assert got[-1]["start"] + got[-1]["n_tokens"] == sum(len(x) + 1 for x in ids_of([t for _, t in rows]))


def test_packing_odd_rows(spark):
    made = frame(spark, ODD + ODD)
    got = packing.pack(made, TOKENIZER)
    assert got.agg(F.sum("length")).first()[0] == 2 * sum(len(x) + 1 for x in ids_of(ODD))
    assert packing.pack(made.limit(0), TOKENIZER).count() == 0


@pytest.mark.parametrize("bits", [False, True])
def test_planes(bits):
    rng = np.random.default_rng(9)
    for n in (0, 1, 7, 8, 100, 1000):
        ids = rng.integers(0, 2**32, n, "u4")
        assert planes.from_planes(planes.to_planes(ids, bits), n, bits).tolist() == ids.tolist()
    docs = [rng.integers(0, 50_000, k, "u4").astype("<u4").tobytes() for k in (0, 3, 1000, 64, 1)]
    segment = planes.Segment(planes.write_segment(docs, 64, bits))
    whole = np.frombuffer(b"".join(docs), "<u4")
    assert segment.lengths.tolist() == [0, 3, 1000, 64, 1]
    for a, b in ((0, 1068), (0, 0), (63, 65), (64, 128), (1000, 1068)):
        assert segment.ids(a, b).tolist() == whole[a:b].tolist()


@pytest.mark.parametrize("bits", [False, True])
def test_token_files(spark, bits):
    texts = ["some words here " * (k % 40) for k in range(120)] + ODD
    rows = [(len(texts) - k, t) for k, t in enumerate(texts)] + [(None, "nameless"), (3, "again"), (3, "again")]
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = planes.file_round_trip(made, TOKENIZER, segment_ids=2000, block_ids=256, bits=bits).orderBy("start").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for r, (name, _), ids in zip(got, order, ids_of([t for _, t in order]), strict=True):
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (name, start, len(ids) + 1)
        assert np.frombuffer(r["ids"], "<u4").tolist() == [*ids, 0]
        start += len(ids) + 1


def test_token_files_empty(spark):
    assert planes.file_round_trip(spark.createDataFrame([], "doc_id long, text string"), TOKENIZER).count() == 0
