"""Operators of maskspark.llm against brute force, SQL and round trips, on small frames with awkward rows."""

import datetime
import hashlib
import pathlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from maskspark.llm import bpe, components, forest, jaccard, licenses, line_dedup, mixing, pseudonyms, quality, queries, repeats, shared, token_files

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared lines and passages, junk; nulls, empty and long texts, repeated rows."""
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    words = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    line, passage, base = "A line that very many of these documents share", words(25), words(120)
    out = []
    for i in range(150):
        kind, text = i % 10, words(rng.randint(15, 90))
        if kind == 1:
            text = base
        elif kind == 2:
            w = base.split()
            w[rng.randrange(len(w))] = "changed"
            text = " ".join(w)
        elif kind == 3:
            text = f"{text}\n {line} \n{words(8)}\n{line.upper()}"
        elif kind == 4:
            text = f"{words(5)} {passage} {words(30)}"
        elif kind == 5:
            text = " ".join(f"{x}### $$$" for x in text.split())
        elif kind == 6:
            text = words(4)
        elif kind == 7:
            text = f"{words(6)} " * 8
        out.append((i * 3 - 20, text, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", "s2", None]), len(text)))
    out += [(900, None, "en", "s0", 0), (901, "", None, None, None), (902, " \n\t ", "en", "s1", 4), (903, LONG, "en", "s0", len(LONG)), out[0], out[13]]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def unique(rows):
    return list({r[0]: r for r in rows}.values())


@pytest.fixture(scope="module")
def clashing(docs):
    """Further columns under names that operators use themselves."""
    extra = ["size", "rate", "pick", "copies", "tag", "keep", "h", "pos", "g", "x0", "ids", "n_words", "cls", "rep", "place", "distance", "license_id", "__size", "__copies", "__text"]
    return docs.select("*", *[F.lit("mine").alias(c) for c in extra])


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- 1


def test_statistics(rows):
    for _, text, *_ in rows:
        n, chars, symbols, dup, repeated, _ = quality.statistics(text, shared.WordHashes())
        words, lines = split(text), [x for x in (text or "").split("\n") if split(x)]
        wins = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        cover = {i + k for i in range(len(words) - 4) if wins[tuple(words[i : i + 5])] > 1 for k in range(5)}
        assert (n, chars, repeated) == (len(words), sum(map(len, words)), len(cover))
        assert symbols == sum(c in "#*$%&|<>" for c in text or "") and dup == len(lines) - len(set(lines))


def test_quality(docs, clashing, rows):
    judged = quality.judge(docs).collect()
    assert len(judged) == len(rows)
    by_id = {r.doc_id: r for r in judged}
    for r in judged:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert not by_id[900].kept and not by_id[901].kept
    one = {r.doc_id: r for r in quality.judge(docs.withColumn("lang", F.lit("en")).withColumn("source", F.lit(None).cast("string"))).collect()}
    assert not any(one[i * 3 - 20].kept for i in range(150) if i % 10 == 5)  # symbols
    assert all(one[i * 3 - 20].kept for i in range(150) if i % 10 in (0, 8, 9))
    kept = quality.keep_good(clashing)
    assert kept.columns == clashing.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in judged if r.kept)
    assert quality.judge(docs.where("false")).count() == 0 and quality.keep_good(docs.where("false")).count() == 0


def test_single_outliers(spark):
    """In an even group, a document that is far off in one statistic alone is rejected."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    even = lambda n=40: "\n".join(" ".join(word() for _ in range(5)) for _ in range(n // 5))
    passage = " ".join(word() for _ in range(9))
    odd = {
        1000: even(4000),
        1001: " ".join(word() * 4 for _ in range(40)),
        1002: even().replace("a", "#").replace("b", "$"),
        1003: "\n".join(f"{' '.join(word() for _ in range(5))}\nyes" for _ in range(8)),  # half of the lines, no window of five words
        1004: " ".join([even(40), passage, even(40), passage]),  # 18 of 98 words
    }
    rows = [(i, even(), "en", "s", 0) for i in range(200)] + [(i, t, "en", "s", 0) for i, t in odd.items()]
    judged = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not any(judged[i].base_failed for i in odd) and all(judged[i].kept for i in range(200))
    assert [i for i in odd if judged[i].kept] == []


def brute_quality(rows):
    """(statistics, base_failed, kept) of each row, the estimates in plain numpy, a group at a time."""
    facts, groups = [], defaultdict(list)
    for k, (_, text, lang, source, *_) in enumerate(rows):
        w, lines = split(text), [x for x in (text or "").split("\n") if split(x)]
        wins = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cover = len({i + j for i in range(len(w) - 4) if wins[tuple(w[i : i + 5])] > 1 for j in range(5)})
        base = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), cover)
        n = max(len(w), 1)
        x = np.array([np.log1p(len(w)), np.log(max(base[1], 1) / n), np.log1p(100 * base[2] / n), np.log1p(10 * base[3] / max(len(lines), 1)), np.log1p(10 * cover / n)])
        failed = len(w) < 10 or 100 * cover > 20 * len(w)
        facts.append([base, failed, False])
        if not failed:
            groups[lang, source].append((k, x))
    floor2 = np.diag(np.square(quality.FLOOR))
    for members in groups.values():
        x = np.array([v for _, v in members])
        n, found = len(x), []
        near = np.floor(x * 32 + 0.5) / 32
        lower = lambda v: np.sort(v, axis=0)[int(np.ceil(n / 2)) - 1]  # noqa: B023, E731
        middle = lower(near)
        for start, (mean, spread) in enumerate([(middle, np.square(1.4826 * lower(np.abs(near - middle)))), (near.mean(axis=0), near.var(axis=0))]):
            cov = np.diag(spread) + floor2
            for _ in range(quality.STEPS):
                far = np.floor(np.log2(np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean) + 2.0**-20) * 64)
                own = x[far <= np.sort(far)[int(np.ceil(0.75 * n)) - 1]]
                scale = max(1.0, 2 ** (lower(far) / 64) / quality.chi2_quantile(5, 0.0))
                mean, cov = own.mean(axis=0), np.cov(own.T, bias=True).reshape(5, 5) + floor2
            found.append((np.linalg.slogdet(cov)[1], start, mean, np.linalg.inv(cov), scale))
        _, _, mean, inverse, scale = min(found, key=lambda m: m[:2])
        for k, v in members:
            facts[k][2] = bool((v - mean) @ inverse @ (v - mean) / scale <= quality.chi2_quantile(5, 4.75))
    return facts


def test_quality_brute_force(docs, rows):
    want = Counter((r[0], *base, failed, kept) for r, (base, failed, kept) in zip(rows, brute_quality(rows)))
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in quality.judge(docs).collect())
    assert got == want and len({k[-2:] for k in want}) == 3


def test_determinant(spark):
    """The estimate of a contaminated cloud is that of its clean part."""
    rng = np.random.default_rng(3)
    clean = rng.normal(0, 1, (400, 5)) @ np.diag([3, 2, 2, 2, 2]) + 5
    bad = rng.normal(40, 1, (80, 5))
    pdf = [("g", *map(float, v)) for v in np.r_[clean, bad]]
    model = quality.estimates(spark.createDataFrame(pdf, "g string, " + ", ".join(f"x{i} double" for i in range(5)))).first()
    assert np.abs(np.array(model.mean) - clean.mean(axis=0)).max() < 1
    far = np.array([(v - model.mean) @ np.array(model.inverse).reshape(5, 5) @ (v - model.mean) / model.scale for v in np.r_[clean, bad]])
    limit = quality.chi2_quantile(5, quality.TAIL_Z)
    assert (far[:400] <= limit).all() and (far[400:] > limit).all()
    assert abs(quality.chi2_quantile(5, 2.3263) - 15.09) < 0.1


# ---- 2


def test_mixing(docs, clashing, rows):
    plan = {r.source: r for r in mixing.source_plan(docs).collect()}
    sizes = defaultdict(int)
    for _, text, _, source, _ in rows:
        sizes[source] += len(split(text))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = float(sum(sizes.values())), set(order), {}
    while open_:  # share by weight, fix those above their limit, share the rest again
        total = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / total > 3 * sizes[s]}
        if not over:
            target |= {s: left * weights[s] / total for s in open_}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    assert {s: r.source_size for s, r in plan.items()} == dict(sizes)
    for s in order:
        assert plan[s].target == pytest.approx(target[s])
    out = mixing.mix(clashing)
    assert out.columns == clashing.columns
    taken, copies = defaultdict(int), Counter()
    for r in out.collect():
        taken[r.source] += len(split(r.text))
        copies[r.doc_id, r.text] += 1
    assert max(copies.values()) <= 6  # rows stand twice
    for s in order:  # no nearer than a document can bring it
        assert abs(taken[s] - target[s]) <= max(len(split(r[1])) for r in rows if r[3] == s)
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
    assert mixing.mix(docs.where("false")).count() == 0


# ---- 3


def test_repeats(spark, docs, clashing, unique):
    first, words = {}, {i: split(t) for i, t, *_ in unique}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    expected = {}
    for i, w in words.items():
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(13)}
        expected[i] = (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeats.dedup(docs, digest=True).collect()}
    assert got == expected and sum(x[1] for x in got.values()) > 500
    out = repeats.dedup(clashing)
    assert set(out.columns) == set(clashing.columns) | {"n_removed"}
    assert repeats.dedup(docs.where("false")).count() == 0
    rng = random.Random(1)  # two words only: windows hit each other everywhere
    binary = [(i * 7 % 101, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in range(100)]
    small = {r.doc_id: r.n_removed for r in repeats.dedup(spark.createDataFrame(binary, "doc_id long, text string"), digest=True).collect()}
    first = {}
    for i, t in sorted(binary):
        w = t.split()
        assert small[i] == len({k + j for k in range(len(w) - 12) if tuple(w[k : k + 13]) in first for j in range(13)})
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i) if tuple(w[k : k + 13]) not in first else None


def test_packing(monkeypatch):
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 100).astype(np.uint64)
    for most in (1000, 2**20, 2**40):
        p = rng.integers(0, most, 100).astype(np.uint64)
        assert all((x == y).all() for x, y in zip(repeats.unpack(repeats.pack(h, p)), (h, p)))
    monkeypatch.setattr(repeats, "_JUDGED", 30)  # a block gone through by ranges holds what it holds as one
    head = np.array([(5, 1, 60), (6, 2, 40)], repeats._DOC).tobytes()
    for whole, items in ((True, repeats.pack(h, p)), (False, repeats.pack_anchors(h, p % np.uint64(2)))):
        found = [(int(d), int(x), int(m)) for _, doc, hashes, marks in repeats._ranges([(head, items)], whole) for d, x, m in zip(doc, hashes, marks)]
        want = zip([0] * 60 + [1] * 40, (h if whole else repeats.short(h)).tolist(), (p if whole else p % np.uint64(2)).tolist())
        assert sorted(found) == sorted(want)


# ---- 4


def test_pseudonyms(spark, clashing):
    text = 'pay 4111 1111 1111 1111, 4111111111111112; born 1990-02-28 or 31.12.1999, not 2021-02-30; 10.1.2.3 300.1.1.1 +1 (212) 555-0123 ab.c9@mail.org 123-45-6789 000-12-1234 "%s"' % ("0af9" * 10)
    df = spark.createDataFrame([(1, text), (2, "4111111111111111 1990-02-28"), (3, None), (4, ""), (5, "plain 12 3.14 v1.2.3.4.5")], "doc_id int, text string")
    got = {r.doc_id: r for r in pseudonyms.pseudonymize(df, "k").collect()}
    new = got[1].text
    assert got[1].n_pseudonyms == 8 and re.sub("[0-9]", "0", re.sub("[a-z]", "a", new.split('"')[0])).count("0000 0000 0000 0000") == 1
    for value in ("4111 1111 1111 1111", "1990-02-28", "31.12.1999", "10.1.2.3", "555-0123", "ab.c9", "123-45-6789", "0af9"):
        assert value not in new
    for value in ("4111111111111112", "2021-02-30", "300.1.1.1", "000-12-1234", "@mail.org", "+1 ("):
        assert value in new
    card = re.search(r"pay ([0-9 ]{19})", new)[1].replace(" ", "")
    assert got[2].text.split()[0] == card and got[2].text.split()[1] in new  # linked across documents
    digits = [int(c) for c in reversed(card)]
    assert (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0
    assert got[3].text is None and got[4].text == "" and got[5].text == "plain 12 3.14 v1.2.3.4.5" and got[5].n_pseudonyms == 0
    assert pseudonyms.pseudonymize(clashing).columns[: len(clashing.columns)] == clashing.columns
    assert pseudonyms.pseudonymize(df, "other").where("doc_id = 2").first().text != got[2].text


def test_pseudonyms_side_by_side(spark):
    """Values next to other digits are found: the parts that must go, those that must stay, and how many values there are."""
    cases = [
        ("+1 (826) 555-4081 190.137.223.204", ["555-4081", "190.137.223.204"], ["+1 ("], 2),
        ("+1 843 555 7672 170.106.47.218", ["555 7672", "170.106.47.218"], ["+1 "], 2),
        ("4111 1111 1111 1111 123", ["4111 1111"], [" 123"], 1),
        ("12 4111-1111-1111-1111 9", ["1111-1111"], ["12 ", " 9"], 1),
        ("4111111111111111 5500005555555559 378282246310005", ["4111111111111111", "5500005555555559", "378282246310005"], [], 3),
        ("4111 1111 1111 1112 4111 1111 1111 1111 77", [], ["4111 1111 1111 1112 ", " 77"], 1),
        ("+1 212 555 0123 4111 1111 1111 1111", ["555 0123", "4111 1111"], ["+1 "], 2),
        ("+86 138 1234 5678 4111 1111 1111 1111 123", ["1234 5678", "4111 1111"], ["+86 ", " 123"], 2),
        ("+1 4111 1111 1111 1111", ["4111 1111"], ["+1 "], 1),
        ("+1 212 555 0123 4111 1111 1111 1111 0128", ["555 0123", "4111 1111"], [" 0128"], 2),
        ("+45 12345678 01/02/2024", ["12345678", "01/02/2024"], [], 2),
        ("1234 5678 2024-03-01 123-45-6789", ["2024-03-01", "123-45-6789"], ["1234 5678 "], 2),
        ("411 1111 1111 1111 1", ["1111 1111"], [], 1),
        ("1234 5678 9012 3456 77@mail.org", ["77@"], ["1234 5678 9012 3456 "], 1),
        ("+41 22 912-45-6789", ["912-45-6789"], ["+41"], 1),
        ("+1-212-555-0123-1", ["212-555-0123"], ["-1"], 1),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "doc_id int, text string")
    for r in pseudonyms.pseudonymize(df, "k").collect():
        text, gone, stays, n = cases[r.doc_id]
        assert r.n_pseudonyms == n and len(r.text) >= len(text) - 12, (text, r.text)
        assert not any(x in r.text for x in gone) and all(x in r.text for x in stays), (text, r.text)


def test_one_to_one(spark):
    """No two values of a format get one pseudonym: all dates between slashes, whichever way they read, and others."""
    days = spark.range(146_097).select(F.date_add(F.lit("1800-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    dates = days.select(F.date_format("d", "dd/MM/yyyy").alias("m")).unionAll(days.select(F.date_format("d", "MM/dd/yyyy"))).distinct()
    short = spark.range(10_000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("d"))
    kinds = {"ssn": F.concat(F.lit("123-45-"), "d"), "phone": F.concat(F.lit("+1 212 555 "), "d"), "secret": F.concat(F.lit("ab" * 14), "d"), "email": F.concat("d", F.lit("@x.org")), "ipv4": F.concat_ws(".", F.lit("10"), F.lit("1"), F.substring("d", 1, 2).cast("int"), F.substring("d", 3, 2).cast("int"))}
    values = dates.select(F.lit("date").alias("kind"), "m")
    for kind, value in kinds.items():
        values = values.unionAll(short.select(F.lit(kind), value))
    new = values.repartition(8).select("kind", "m", pseudonyms.pseudonym(F.col("m"), "k").alias("p")).cache()
    found = {r[0]: r[1:] for r in new.groupBy("kind").agg(F.count("p"), F.countDistinct("p")).collect()}
    # serials of four noughts are no valid number
    assert found == {"date": (234_594, 234_594), "ssn": (9_999, 9_999), **{k: (10_000, 10_000) for k in ("phone", "secret", "email", "ipv4")}}
    assert new.where("kind = 'date'").select(F.col("p").alias("m")).join(dates, "m", "left_anti").count() == 0
    new.unpersist()


def test_brute_feistel(spark):
    """Each kind against the networks written in plain Python."""
    key = "k"

    def turned(a, b, n, kind, hexadecimal):
        base = f"{key}|{kind}|{n}|{len(a)}|{b}"
        stream = "".join(hashlib.sha512((base + (f"|{k}" if k else "")).encode()).hexdigest() for k in range(max(1, -(-len(a) // 32))))
        out = ""
        for i, c in enumerate(a):
            by = int(stream[4 * i : 4 * i + 4], 16)
            if hexadecimal:
                out += "0123456789abcdef"[(int(c, 16) + by) % 16]
            else:
                signs = next((s for s in ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if c in s), c)
                out += signs[(signs.index(c) + by) % len(signs)]
        return out

    def network(text, kind, hexadecimal=False):
        left, right = text[: len(text) // 2], text[len(text) // 2 :]
        for n in range(8):
            if n % 2:
                right = turned(right, left, n, kind, hexadecimal)
            else:
                left = turned(left, right, n, kind, hexadecimal)
        return left + right

    def number(x, a, b, kind):
        left, right = divmod(x, b)
        draw = lambda n, v: int(hashlib.sha256(f"{key}|{kind}|{n}|{v}".encode()).hexdigest()[:14], 16)
        for n in range(8):
            if n % 2:
                right = (right + draw(n, left)) % b
            else:
                left = (left + draw(n, right)) % a
        return left * b + right

    def luhn(body):
        return str(-sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(body))) % 10)

    def day(text, fmt, late):
        start, x = datetime.date(1800, 1, 1), datetime.datetime.strptime(text, fmt).date()
        shape = fmt.replace("%Y", "yyyy").replace("%m", "MM").replace("%d", "dd")
        n = number((x - start).days, 189, 773, f"date {shape}")
        while late and (start + datetime.timedelta(n)).day <= 12:
            n = number(n, 189, 773, f"date {shape}")
        return (start + datetime.timedelta(n)).strftime(fmt)

    def ssn(text):
        while True:
            text = network(text, "ssn")
            if not re.search("^(?:000|666|9)|-00-|-0000$", text):
                return text

    rng = random.Random(3)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    cases = {}
    for _ in range(25):
        local = "".join(rng.choice("aZ09._b") for _ in range(rng.choice([1, 7, 64, 65, 150])))
        cases[f"{local}@mail.org"] = network(local, "email") + "@mail.org"
        secret = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([32, 40, 64])))
        cases[secret] = network(secret, "secret", True)
        rest = f" (212) {digits(3)}-{digits(4)}"
        cases["+1" + rest] = "+1" + network(rest, "phone")
        body = digits(rng.randint(12, 18))
        new = network(body, "card")
        cases[body + luhn(body)] = new + luhn(new)
        octets = [rng.randrange(256) for _ in range(4)]
        x = number(int.from_bytes(bytes(octets)), 1 << 16, 1 << 16, "ipv4")
        cases[".".join(map(str, octets))] = ".".join(map(str, x.to_bytes(4)))
        area = f"1{digits(2)}-4{digits(1)}-{digits(3)}7"
        cases[area] = ssn(area)
        d = datetime.date(1990, 1, 1) + datetime.timedelta(rng.randrange(9000))
        cases[d.strftime("%Y-%m-%d")] = day(d.strftime("%Y-%m-%d"), "%Y-%m-%d", False)
        cases[d.strftime("%d.%m.%Y")] = day(d.strftime("%d.%m.%Y"), "%d.%m.%Y", False)
        cases[d.strftime("%m-%d-%Y")] = day(d.strftime("%m-%d-%Y"), "%m-%d-%Y" if d.day > 12 else "%d-%m-%Y", d.day > 12)
    df = spark.createDataFrame(list(cases.items()), "m string, want string")
    for r in df.select("m", "want", pseudonyms.pseudonym(F.col("m"), key).alias("got")).collect():
        assert r.got == r.want, r
    long = "x" * 300 + "@mail.org"
    out = pseudonyms.pseudonymize(spark.createDataFrame([(1, f"to {long}, 2024-01-02T10:00")], "doc_id int, text string"), key).first()
    assert "xxxx" not in out.text and out.n_pseudonyms == 1


# ---- 5


def test_token_files(spark, docs, tmp_path, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_files.default_path())
    folder = str(tmp_path / "ids")
    token_files.write(docs, folder)
    got = token_files.read(spark, folder).orderBy("start").collect()
    at, expected = 0, Counter()
    for i, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        expected[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == expected
    for a, b in zip(got, got[1:]):
        assert a.doc_id <= b.doc_id
    for r in got:
        assert r.start == at
        at += r.n_tokens
    token_files.write(spark.createDataFrame([(None, "one"), (3, None), (None, "two words"), (-4, "x")], "doc_id long, text string").select("*", F.lit(1).alias("place")), str(tmp_path / "null"))
    odd = [(r.doc_id, r.start, r.n_tokens) for r in token_files.read(spark, str(tmp_path / "null")).orderBy("start").collect()]
    assert [x[0] for x in odd] == [None, None, -4, 3] and [x[1] for x in odd] == [0, *np.cumsum([x[2] for x in odd])[:-1]]
    token_files.write(docs.where("false"), str(tmp_path / "none"))
    assert token_files.read(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("values", [[], [7], [0] * 3000, [0] * 2000 + [2**32 - 1], list(range(5000)), [2**32 - 1] * 1024])
def test_blocks(values):
    x = np.array(values, np.uint32)
    names, counts, ids = token_files.read_part(token_files.write_part([None, -5], [x, x[:3]]))
    assert names == [None, -5] and counts.tolist() == [len(x), len(x[:3])] and ids.tolist() == [*values, *values[:3]]
    part = token_files.Part(token_files.write_part([1, 2, 3], [x, x[:3], x]))
    assert part.document(2).tolist() == values and part.document(1).tolist() == values[:3]


def test_encoder():
    """Ids of texts of odd signs, by pieces, against the library."""
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(token_files.default_path()), token_files.Encoder(token_files.default_path())
    rng = random.Random(11)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["", "a" * 5000]
    expected = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    assert own.by_piece and own.encode(texts) == expected and own.encode(texts[::-1]) == expected[::-1]
    other = token_files.Encoder(bpe.default_path())  # a file of another make is left to the library
    assert not other.by_piece
    assert other.encode(["One two"])[0] == np.array(Tokenizer.from_file(bpe.default_path()).encode("One two", add_special_tokens=False).ids, "<u4").tobytes()


def test_encoder_by_kinds():
    """Pieces cut by kinds of bytes, against the library: contractions, runs of spaces, borders between texts, nulls, foreign texts between."""
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(token_files.default_path()), token_files.Encoder(token_files.default_path())
    rng = random.Random(12)
    parts = ["'", "'s", "'re", "'ll", "'l", "'r", "s", "e", "l", "m", "V", "é", "À", "ß", "0", "19", ".", "!?", " ", "  ", "\n", "\t", "\r\n", " \n "]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(20000)] + ["it's", "we'll go", " 's", "''s", "'s's", "x ", " x"]
    texts += [None, "", "'", "s", "'r", "e", "<", "|", "3×4", "中文 it's", "<|endoftext|>", "\x7f", "µ", None, "'ll"]
    expected = [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4") for t in texts]
    for start, end in ((0, 20000), (0, len(texts)), (19990, len(texts) - 1), (3, 4), (5, 5)):
        ids, counts = own.column(pa.array(texts).slice(start, end - start))
        assert counts.tolist() == [len(x) for x in expected[start:end]] and ids.tolist() == [i for x in expected[start:end] for i in x.tolist()]
    with pytest.raises(pa.ArrowInvalid):
        own.column(pa.array([b"a\x80"]).view(pa.string()))


def test_encoder_lookups():
    """Each distinct piece of a slice of texts is looked up once, not each piece."""

    class Counted(dict):
        n = 0

        def __getitem__(self, key):
            Counted.n += 1
            return super().__getitem__(key)

        def get(self, key, default=None):
            Counted.n += 1
            return super().get(key, default)

    rng = random.Random(13)
    words = ["".join(rng.choices("etaoinshrdlué", k=rng.randint(1, 12))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=500)) + "." for _ in range(600)]
    own = token_files.Encoder(token_files.default_path())
    own.known = Counted()
    expected = [np.array(e.ids, "<u4").tobytes() for e in own.library.encode_batch(texts, add_special_tokens=False)]
    assert own.encode(texts) == expected == own.encode(texts) and Counted.n <= 2 * (2 * len(words) + 1)


# ---- 6


def brute_groups(rows):
    sets = {}
    for i, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_jaccard(spark, docs, clashing, unique):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    expected = brute_groups(unique)
    assert got == expected and len({c for _, c in got.values()}) < len(got) - 20
    kept = jaccard.keep_one(clashing)
    assert kept.columns == clashing.columns and {r.doc_id for r in kept.collect()} == {c for _, c in expected.values()}
    assert jaccard.near_duplicates(docs.where("doc_id in (900, 901)")).count() == 2


@pytest.mark.parametrize("limits", [{}, {"BLOCK_ROWS": 10, "MOST_HOT": 5}, {"BLOCK_ELEMENTS": 700, "MOST_HOT": 0}])
def test_jaccard_families(spark, monkeypatch, limits):
    """Families of near copies, in which most pairs link and many just fail to; also where blocks must be split."""
    for name, value in limits.items():
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(160):
        w = list(base) if i % 2 else [f"v{x}" for x in base]
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(80)] = f"x{rng.randrange(30)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_groups(rows)


def near_families(n=240):
    """Texts of long families that share most columns and just fail to link, or just link."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        w = list(base)
        for k in rng.sample(range(300), 3 + i % 2):
            w[k] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("limits", [{"DENSE": 0}, {"DENSE": 2, "BLOCK_ROWS": 10, "_SMALL": 4}, {"BLOCK_ROWS": 10}])
def test_jaccard_pairs_met(spark, monkeypatch, limits):
    """Each link is met, whether a block sends its pairs or its rows, and however blocks are split."""
    for name, value in limits.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = near_families(120)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute_groups(rows)


def test_jaccard_sent_once(spark, monkeypatch):
    """A pair that shares many columns is multiplied in one of their blocks, not in each."""
    n, real = spark.sparkContext.accumulator(0), jaccard._across

    def counting(t):
        inner = real(t)

        def run(batches):
            def counted():
                for b in batches:
                    n.add(b.num_rows)
                    yield b

            yield from inner(counted())

        return run

    monkeypatch.setattr(jaccard, "_across", counting)
    words = [[f"{k}w{i}" for i in range(300)] for k in range(20)]
    rows = [(2 * k + j, " ".join(f"x{i}" if j and i % 40 == 20 else x for i, x in enumerate(w))) for k, w in enumerate(words) for j in range(2)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_groups(rows)
    assert 0 < n.value <= len(rows)


@pytest.mark.parametrize("small", [4, 32])
def test_jaccard_rows_made(spark, monkeypatch, small):
    """Groups whose pairs share most columns and just fail to link: their blocks send on rows, fewer than they were given."""
    monkeypatch.setattr(jaccard, "_SMALL", small)
    given, made, real = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0), jaccard.lean

    def counting(run):
        def both(batches):
            of_pairs = []

            def counted():
                for b in batches:
                    of_pairs.append({"tok", "sketch"} <= set(b.schema.names))
                    given.add(b.num_rows * of_pairs[-1])
                    yield b

            for b in run(counted()):
                made.add(b.num_rows * of_pairs[-1])
                yield b

        return real(both)

    monkeypatch.setattr(jaccard, "lean", counting)
    rows = []
    for k in range(12):
        for i in range(16):
            w = [f"{k}w{x}" for x in range(300)]
            for x in (18 * i, 18 * i + 2, 18 * i + 7, 18 * i + 12):
                w[x + 5] = f"x{i}"
            rows.append((len(rows), " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_groups(rows)
    assert 0 < made.value < given.value


def test_bounds():
    rng = np.random.default_rng(2)
    for _ in range(200):
        x = np.unique(rng.integers(0, 2**63, rng.integers(1, 300)).astype(np.uint64))
        y = np.unique(np.r_[x[rng.random(len(x)) > 0.1], rng.integers(0, 2**63, 5).astype(np.uint64)])
        both = len(np.intersect1d(x, y))
        assert jaccard.overlaps([x, y[:3]], [y], columns=7).tolist() == [[both], [len(y[:3])]]
        differ = int(jaccard.Sketches([jaccard.parity(x), jaccard.parity(y)]).bits(np.array([0]), np.array([1]))[0]) if 0.6 < len(x) / len(y) < 1.6 else 0
        assert differ <= len(x) + len(y) - 2 * both


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(500, 500), (None, 3)]
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a is not None:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component_id for r in got} == {i: root(i) for i in parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("held", [1 << 20, 500])
def test_long_chain(spark, monkeypatch, held):
    """A chain in order of its ids and a star take few rounds, also where no task may hold all edges."""
    rounds, cut = [], components.cut
    monkeypatch.setattr(components, "HELD", held)
    monkeypatch.setattr(components, "cut", lambda df, **how: rounds.append(1) or cut(df, **how))
    edges = [(i, i + 1) for i in range(5000)] + [(10_000 + i % 2, 10_002 + i) for i in range(20_000)]
    got = components.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).groupBy("component_id").count().collect()
    assert sorted(map(tuple, got)) == [(0, 5001), (10_000, 10_001), (10_001, 10_001)]
    assert len(rounds) <= 26


# ---- 7


def links_of(x):
    """Pairs of rows of x with a cosine of 0.95 or more, by brute force."""
    u = x.astype(np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for at in range(0, len(u), 2000):
        i, j = np.nonzero(u[at : at + 2000] @ u.T >= 0.95)
        yield from ((a, b) for a, b in zip((i + at).tolist(), j.tolist()) if a < b)


def found_links(spark, x, odd=(), **options):
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).repartition(4)
    return df, forest.near_duplicates(df, **options).collect()


@pytest.mark.parametrize("part", [2048, 20])
def test_forest(spark, monkeypatch, part):
    """Also where large leaves are dealt to blocks."""
    monkeypatch.setattr(forest, "LEAF", 64)
    monkeypatch.setattr(forest, "PART", part)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(60, 16))
    x = np.r_[rng.normal(size=(300, 16)), np.repeat(centres, 5, axis=0) + rng.normal(size=(300, 16)) * 0.12, np.repeat(centres[:1], 50, axis=0)]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [1.0, 2.0]), (1005, [2.0, 4.0]), (1006, [1e-200] * 16), (1007, [1e200] * 16)]
    odd += [(None, [3.0, 0.0, 0.0]), (1010, [3.0, 0.1, 0.0]), (1009, [3.0, 0.0, 0.1]), (None, [0.0, 1.0, 0.0]), (None, [0.0, 1.0, 0.01]), (1012, [None, 1.0])]
    df, rows = found_links(spark, x, odd)
    got = {r.vec_id: r for r in rows}
    true = Counter(i for pair in links_of(x) for i in pair)
    assert all(got[i].n_links <= true[i] for i in range(len(x))) and sum(got[i].n_links for i in range(len(x))) >= 0.98 * true.total() > 2000
    assert [got[i].n_links for i in (1000, 1001, 1002, 1003, 1012)] == [0] * 5 and got[1000].kept and got[1000].component_id == 1000
    assert got[1005].component_id == 1004 and got[1007].component_id == 1006
    null = sorted((r.component_id or 0, r.n_links, r.kept) for r in rows if r.vec_id is None)
    assert null == [(0, 1, True), (0, 1, True), (1009, 2, False)] and got[1010].component_id == 1009 and got[1009].kept
    assert forest.near_duplicates(df.where("false")).count() == 0 and forest.near_duplicates(df.where("vec_id = 1000")).count() == 1


@pytest.mark.parametrize("dim, part", [(64, 8192), (64, 100), (3, 8192), (3, 50)])
def test_forest_exact(spark, monkeypatch, dim, part):
    """Every link, by brute force, in chains of vectors that lie at the threshold; where trees can split and where they cannot."""
    monkeypatch.setattr(forest, "PART", part)
    monkeypatch.setattr(forest, "LEAF", 16)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(400, dim))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    steps = rng.normal(size=(4, 400, dim))
    steps *= 0.31 / np.linalg.norm(steps, axis=2, keepdims=True)
    x = np.concatenate([centres, *(centres + np.cumsum(steps, axis=0))])
    true = Counter(i for pair in links_of(x) for i in pair)
    got = {r.vec_id: r.n_links for r in found_links(spark, x, trees=1)[1]}
    assert got == {i: true[i] for i in range(len(x))} and true.total() > 1000
    narrow = {r.vec_id: r.n_links for r in found_links(spark, x, trees=1, exact=False)[1]}
    assert all(narrow[i] <= true[i] for i in narrow) and (dim == 3 or sum(narrow.values()) < true.total())
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cells = forest.ExactTree(0, dim, 8, 0.95).fit(u[:500]).cells(u)
    assert (len(cells) > 4) == (dim == 3)


def test_forest_recall(spark):
    """With production constants over 50,000 vectors: nine in ten links at least, by brute force, in clusters that lie near the threshold."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(4000, 32))
    x = np.r_[rng.normal(size=(30_000, 32)), np.repeat(centres, 5, axis=0) + rng.normal(size=(20_000, 32)) * 0.17]
    true = Counter(i for pair in links_of(x) for i in pair)
    got = {r.vec_id: r.n_links for r in found_links(spark, x)[1]}
    assert all(got[i] <= true[i] for i in got) and sum(got.values()) >= 0.98 * true.total() > 20_000


# ---- 8


def brute_lines(rows):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip("\x20\t\n\x0b\x0c\r"))
    where = defaultdict(set)
    for i, text, *_ in rows:
        for x in (text or "").split("\n"):
            where[key(x)].add(i)
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 40 and len(where[key(x)]) >= 5 and i != max(where[key(x)]))]
        yield i, (len(lines), len(lines) - len(kept), "\n".join(kept))


def test_lines(docs, clashing, unique):
    expected = dict(brute_lines(unique))
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.digests(docs, line_dedup.keep_bitmaps(docs)).collect()}
    assert got == {i: (n, d, sha(t)) for i, (n, d, t) in expected.items()} and sum(d for _, d, _ in got.values()) > 20
    out = line_dedup.dedup_lines(clashing)
    assert out.columns == clashing.columns and {r.doc_id: r.text or "" for r in out.collect()} == {i: t for i, (_, _, t) in expected.items()}
    assert line_dedup.dedup_lines(docs.where("false")).count() == 0


def test_long_runs(spark):
    """Runs of equal lines over many batches and partitions."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        pool = [f"line number {i} is long enough to be a key, é" for i in range(6)]
        rng = random.Random(2)
        rows = [(i, "\n".join(rng.choice(pool[: 1 + i % 6]) for _ in range(rng.randint(0, 6)))) for i in range(300)]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
        got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.digests(df, line_dedup.keep_bitmaps(df)).collect()}
        assert got == {i: (n, d, sha(t)) for i, (n, d, t) in brute_lines(rows)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# ---- 9

SIGNS = list("aAbß é́'sST\n\t  12٣　ſΣςİ!?…你好😀") + ["<|endoftext|>", "'re", "'LL", "\x1c", "\x85", "ﬁ"]


def test_bpe(spark, docs, clashing, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    rng = random.Random(8)
    odd = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 50))) for _ in range(800)] + ["a" * 3000]
    df = docs.select("doc_id", "text").unionAll(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    got = bpe.decode(bpe.encode(df)).collect()
    digests = Counter(map(tuple, bpe.digests(df).collect()))
    expected = Counter()
    for r in got:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
        expected[r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(r.decoded)] += 1
    assert digests == expected
    wide = bpe.encode(clashing)
    assert set(wide.columns) == set(clashing.columns) and dict(wide.dtypes)["ids"] == "array<int>"
    assert bpe.encode(docs.where("false")).count() == 0


# ---- 10


def test_lean_workers():
    """A worker that goes over to another operator lets go of the vocabulary, and holds it for its own."""
    passed = lambda owner: list(shared.lean(iter, owner)([1, 2]))
    bpe.codec(bpe.default_path())
    assert passed("bpe") == [1, 2] and len(bpe._codecs) == 1
    assert passed("") == [1, 2] and not bpe._codecs


def test_licenses(spark, docs, clashing):
    mit = licenses.KNOWN[0][1]
    texts = ["Copyright (c) 2020 A\n\n" + mit.upper(), "# " + mit.replace("license", "licence").replace(",", " ,"), "Released under the MIT LICENCE!", mit + " and more", None, "", "...", "© 2021 by B\nlicensed under cc by-nc 4.0"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.license_id for r in licenses.scan(df).collect()}
    assert got == {0: "MIT", 1: "MIT", 2: "MIT", 3: None, 4: None, 5: None, 6: None, 7: "CC-BY-NC-4.0"}
    out = licenses.scan(clashing)
    assert out.count() == clashing.count() and set(out.columns) == set(clashing.columns) | {"license_digest"}
    own = licenses.known_digests(spark, [("house", "Use it as you like.")])
    assert licenses.scan(spark.createDataFrame([("use it AS you like",)], "text string"), own).first().license_id == "house"


def test_full_licenses(spark):
    """Texts as they are found in files: numbered conditions, other titles or none, whole long licences."""
    by = {i: t for i, t in reversed(licenses.KNOWN[:5])}
    bsd = lambda k, ns: "\n".join(f"{n} {x}".strip() for n, x in zip(ns, by[k].split("\n")[1:]))
    folder = pathlib.Path(licenses.__file__).parent / "texts"
    cases = [("BSD-2-Clause", "Copyright (c) 2021, A\n" + bsd("BSD-2-Clause", ["", "1.", "2.", ""])), ("BSD-3-Clause", "BSD 3-Clause License\n\n" + bsd("BSD-3-Clause", ["", "1.", "2.", "3.", ""]))]
    cases += [("BSD-3-Clause", bsd("BSD-3-Clause", ["", "(i)", "(ii)", "(iii)", ""])), ("MIT", by["MIT"].split("\n", 1)[1]), ("MIT", "The MIT License (MIT)\n\nCopyright (c) 2020 B\n" + by["MIT"].split("\n", 1)[1])]
    cases += [(f.stem, f.read_text()) for f in sorted(folder.glob("*.txt"))]
    cases += [("Apache-2.0", "\n".join(x.strip() for x in (folder / "Apache-2.0.txt").read_text().split("END OF TERMS")[0].splitlines()))]
    cases += [("MIT", by["MIT"].replace("permission notice", "permission notice,\n")), ("Zlib", (folder / "Zlib.txt").read_text().upper().replace("ACKNOWLEDGMENT", "Acknowledgement"))]
    pair = spark.createDataFrame([("licence licence",), ("sub license sub license",), ("license license",), ("sublicense sublicense",)], "t string").select(licenses.normalized(F.col("t")).alias("t"))
    assert [r.t for r in pair.collect()] == ["license license", "sublicense sublicense"] * 2
    assert {"CC-BY-4.0", "Zlib", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense"} <= {c[0] for c in cases}
    df = spark.createDataFrame([(i, c[1]) for i, c in enumerate(cases)], "doc_id int, text string")
    got = {r.doc_id: r.license_id for r in licenses.scan(df).collect()}
    assert got == {i: c[0] for i, c in enumerate(cases)}


# ---- all


@pytest.mark.parametrize("name", sorted(queries.oracle_sql().keys() - {"op6_ngram_jaccard"}))  # that one has brute force above
def test_sql(spark, tmp_path, docs, name, unique):
    import duckdb

    spark.createDataFrame([r for r in unique if r[0] != 903], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    expected = db.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, str(tmp_path))
    assert sorted(got.columns) == sorted(expected.columns)
    columns = sorted(got.columns)
    want = sorted((tuple(dict(zip(expected.columns, r))[c] for c in columns) for r in expected.fetchall()), key=repr)
    have = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)
    for a, b in zip(have, want, strict=True):
        assert a == pytest.approx(b)


def brute_mix(rows):
    """Rows as often as the mix takes them: targets by sharing again and again, the draws from MD5."""
    sizes = defaultdict(int)
    for _, text, _, source, _ in rows:
        sizes[source] += len(split(text))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights, open_, left, target = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, set(order), float(sum(sizes.values())), {}
    while open_:
        total = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / total > 3 * sizes[s]}
        target |= {s: 3.0 * sizes[s] if over else left * weights[s] / total for s in over or open_}
        left -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    mask, out = 2**48 - 1, []
    for s in order:
        rate = min(target[s] / sizes[s], 3.0) if sizes[s] else 0.0
        mine = []
        for r in (r for r in rows if r[3] == s):
            size = len(split(r[1]))
            digest = hashlib.md5(f"mix-1:{'null' if r[0] is None else r[0]}:{size}".encode()).hexdigest()
            mine.append((r, size, int(digest[:12], 16), int(digest[12:24], 16) | 1))
        taken = lambda k: [int(rate) + (((a + k * b) & mask) / 2.0**48 < rate - int(rate)) for _, _, a, b in mine]  # noqa: B023, E731
        pick = min(range(32), key=lambda k: (abs(sum(n * m[1] for n, m in zip(taken(k), mine)) - target[s]), k))  # noqa: B023
        out += [m[0] for n, m in zip(taken(pick), mine) for _ in range(n)]
    return out


def test_pipeline_brute_force(spark, docs, rows, tmp_path):
    """The chain of stages, each against its brute force on what the brute force of the one before it left."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    odd = [(None, "no id " + " ".join(f"n{i}" for i in range(30)), "en", "s0", None), (None, None, None, None, None), (905, "", "en", "s1", 0)]
    now = [*rows, *odd]
    frame = spark.createDataFrame(now, SCHEMA).withColumn("__text", F.lit("mine")).withColumn("size", F.lit(1))
    stages = dict(corpus_pipeline.STAGES)
    flat = lambda df: Counter(tuple(r)[:5] for r in df.collect())

    frame = stages["quality rules"](spark, frame, str(tmp_path))
    now = [r for r, (_, _, kept) in zip(now, brute_quality(now)) if kept]
    assert flat(frame) == Counter(now) and frame.columns[-2:] == ["__text", "size"]
    frame = stages["line dedup"](spark, frame, str(tmp_path))
    now = [(*r[:1], t, *r[2:4], len(t)) for r, (_, (_, _, t)) in zip(now, brute_lines([(r[0] if r[0] is not None else -(10**6), *r[1:]) for r in now]))]
    assert flat(frame) == Counter(now)
    frame = stages["n-gram Jaccard join"](spark, frame, str(tmp_path))
    groups = brute_groups([(r[0] if r[0] is not None else 10**6, *r[1:]) for r in now])
    now = [r for r in now if r[0] is None or groups[r[0]][1] == r[0]]
    assert flat(frame) == Counter(now)
    frame = stages["mixing sources to target weights"](spark, frame, str(tmp_path))
    now = brute_mix(now)
    assert flat(frame) == Counter(now)
    last = stages["BPE encoding and decoding"](spark, frame, str(tmp_path))
    want = Counter()
    for r in now:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want[r[0], r[2], r[3], len(ids), tuple(ids), library.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r.doc_id, r.lang, r.source, r.n_tokens, tuple(r.ids), r.decoded) for r in last.collect()) == want and len(want) > 50
    empty = frame.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_pipeline(spark, docs, tmp_path, monkeypatch):
    import corpus_pipeline

    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
    assert now.count() > 0 and 900 not in {r.doc_id for r in now.collect()}
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[3:])
    assert {"doc_id", "ids", "decoded"} <= set(corpus_pipeline.run(spark, str(tmp_path)).columns)
