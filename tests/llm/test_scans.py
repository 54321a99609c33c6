"""Media, URL filters, secrets and decontamination against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from quarry.llm import decontaminate, media, secrets, urls
from quarry.llm.common import scratch


def test_media(spark, odd, odd_rows, none):
    got = media.media_features(odd).collect()
    assert len(got) == len(odd_rows)
    want = Counter()
    for i, t in odd_rows:
        pay, n = media.payload(t or "")
        want[i, n, len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-32:])] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    same = {(r["payload_sha256"], r["media_sha256"], r["media_bytes"], r["feature"]) for r in got}
    assert len(same) == len({r["payload_sha256"] for r in got})
    assert media.media_features(none).count() == 0


@pytest.mark.parametrize("part", ["pool", "media", "staged"])
def test_lost_media_are_errors(spark, tmp_path, part):
    rng = random.Random(4)
    shared = "".join(chr(rng.randrange(97, 123)) for _ in range(60_000))
    docs = spark.createDataFrame([(0, shared + "a" * 9000), (1, "other " * 4000 + shared), (2, "alone")], "doc_id long, text string")
    root = media.write_media(docs, str(tmp_path / "m"))
    assert media.read_features(spark, root).count() == 3
    folder = f"{root}/staged/kind=solo" if part == "staged" else f"{root}/rest/part={part}"
    none = spark.read.parquet(folder)
    spark.createDataFrame([], none.schema).write.mode("overwrite").parquet(folder)
    with pytest.raises(Exception, match="there is no (chunk|payload)"):
        media.read_features(spark, root).collect()


def brute_media(text):
    """All values of one text, byte by byte: padding, rolling hash, chunks, frames, stored form and feature."""
    raw = (text or "").encode()
    pay = raw + b"\xff" * (576 - len(raw) % 576 if len(raw) % 576 or not raw else 0)
    mask = 2**64 - 1
    gears = []
    for i in range(256):
        x = (i + 0x9E3779B97F4A7C15) & mask
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        gears.append((x ^ x >> 31) >> 32)
    chunks, start, h = [], 0, 0
    for i, b in enumerate(pay):
        h = ((h << 1) + gears[b]) & 0xFFFFFFFF
        n = i + 1 - start
        if (n >= 2048 and h >> 20 == 0 and i + 1 < len(pay)) or n == 16384:
            chunks.append(pay[start : i + 1])
            start = i + 1
    if start < len(pay):
        chunks.append(pay[start:])
    form = b""
    for part in chunks:
        frame = zstandard.ZstdCompressor(level=6).compress(part)
        assert zstandard.ZstdDecompressor().decompress(frame) == part
        form += hashlib.blake2b(part, digest_size=16).digest() + len(part).to_bytes(4, "little") + len(frame).to_bytes(4, "little") + frame
    counts = Counter(pay)
    mean = sum(pay) / len(pay)
    std = (sum((b - mean) ** 2 for b in pay) / len(pay)) ** 0.5
    entropy = -sum(v / len(pay) * math.log2(v / len(pay)) for v in counts.values())
    feature = (len(pay) // 576, round(mean, 3), round(std, 3), round(entropy, 4), len(counts))
    return len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-32:]), len(form), hashlib.sha256(form).hexdigest(), feature


def test_media_against_brute_force(spark, odd, odd_rows):
    rng = random.Random(8)
    texts = [t for _, t in odd_rows] + ["".join(rng.choice("abcdefgh éß日\n") for _ in range(n)) for n in (575, 576, 577, 9000, 40_000)]
    texts += ["z" * 50_000, texts[-1][:30_000] + "tail", texts[-1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")
    for r in media.media_features(docs).collect():
        *want, (rows, mean, std, entropy, distinct) = brute_media(texts[r["doc_id"]])
        assert [r[n] for n in names] == want
        found = re.fullmatch(r"(\d+)x576 mean=([\d.]+) std=([\d.]+) entropy=(-?[\d.]+) distinct=(\d+)", r["feature"])
        assert (int(found[1]), int(found[5])) == (rows, distinct)
        assert all(abs(float(found[k]) - v) <= 1.1e-3 for k, v in ((2, mean), (3, std), (4, entropy)))


def test_shared_chunks_are_pooled_once(spark):
    rng = random.Random(5)
    part = "".join(rng.choice("abcdefgh ") for _ in range(60_000))
    docs = spark.createDataFrame([(i, f"{i} " * 3000 + part) for i in range(6)] + [(9, part), (10, part)], "doc_id long, text string").repartition(4)
    root = media.write_media(docs, scratch(spark, "m"))
    pool = spark.read.parquet(f"{root}/rest").filter("part = 'pool'")
    assert pool.count() == pool.select("key").distinct().count() > 3
    rows = media.read_media(spark, root).collect()
    assert len(rows) == 7 and not any(f is None for r in rows for f in r["frames"])
    stored = sum(len(f) for r in spark.read.parquet(f"{root}/rest").collect() for f in r["frames"] if f)
    assert stored < sum(len(f) for r in rows for f in r["frames"]) / 2.5


def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.split("[?#]", rest[len(host) :], maxsplit=1)[0]


def test_urls(spark):
    cases = [
        None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1?x=/es/", "https://example.com", "https://a.example.com/en/2", "https://www.example.com/en/3#x", "http://notexample.com/en/4",
        "http://x.net/es/5", "http://net/fr/6", "http://x.net/de/7", "ftp://É.net/es/8", "http://a.net?q=/es/", "a://b://c/d", "http://com/9", "http://x.net/es/5",
    ]
    df = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("template", F.lit(1))
    got = {r["page_id"]: r for r in urls.judge(df).collect()}
    assert len(got) == len(cases)
    rules = sorted(urls.RULES, key=lambda r: -len(r[1]))
    for i, url in enumerate(cases):
        host, path = brute_url(url)
        assert (got[i]["host"], got[i]["path"]) == (host, path)
        fit = next(((say, t) for say, t in rules for h, p in [t.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)), None)
        assert got[i]["rule"] == (fit[1] if fit else None)
        assert got[i]["verdict"] == (fit[0] if fit else got[i]["verdict"]) in ("allow", "block")
    assert urls.judge(df.limit(0)).count() == 0


def test_templates_follow_their_labels(spark):
    rows = [(i, f"http://h.org/ads/{i}", True if i % 2 else None) for i in range(40)] + [(100 + i, f"http://h.org/news/{i}", False if i % 2 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    got = {r["page_id"]: (r["verdict"], r["template"]) for r in urls.judge(df, (), F.col("bad")).collect()}
    assert {v for i, (v, _) in got.items() if i < 100} == {"block"}
    assert {v for i, (v, _) in got.items() if i >= 100} == {"allow"}
    assert got[3][1] == "/ads/{n}"


def brute_tree(rows):
    """Verdict and template of (host, path, label or None) by the method's definition, over plain dictionaries."""
    leaves = {}
    for host, path, label in rows:
        flat = re.sub("[0-9]+", "{n}", re.sub("(?<![A-Za-z0-9])(?=[a-f]*[0-9])[0-9a-f]{12,}(?![A-Za-z0-9])", "{x}", path))
        parts = flat.removeprefix("/").split("/", 5)
        leaves.setdefault((host, tuple(parts)), []).append(label)
    trees = {k: ("",) for k in leaves}
    for level in range(6):
        children = {}
        for (host, parts), at in trees.items():
            if len(parts) > level:
                children.setdefault((host, at[-1]), set()).add(parts[level])
        for (host, parts), at in list(trees.items()):
            if len(parts) > level:
                part = parts[level]
                if len(children[host, at[-1]]) > 32 and part not in ("{n}", "{x}"):
                    part = re.sub("^[^.]*", "{s}", part)
                trees[host, parts] = (*at, f"{at[-1]}/{part}")
    counts = {}
    for (host, parts), at in trees.items():
        known = [x for x in leaves[host, parts] if x is not None]
        for d, node in enumerate(at):
            b, n, _ = counts.get((host, d, node), (0, 0, None))
            counts[host, d, node] = (b + sum(known), n + len(known), at[d - 1] if d else None)
    def merged(host, d, node):
        b, n, parent = counts[host, d, node]
        kin = [v for (h, e, x), v in counts.items() if (h, e, v[2]) == (host, d, parent) and x != node]
        ob, on = sum(v[0] for v in kin), sum(v[1] for v in kin)
        if d and n and on:
            pool = (b + ob) / (n + on)
            if abs(b / n - ob / on) <= 1.96 * (pool * (1 - pool) * (1 / n + 1 / on)) ** 0.5:
                return b + ob, n + on
        return b, n
    pure = {}
    for (host, _), at in trees.items():
        p = 0.2
        for d, node in enumerate(at):
            votes = [round(1e6 * v[0] / v[1]) / 1e6 for (h, e, x), v in counts.items() if (e, x) == (d, node) and h != host and v[1]]
            b, n = merged(host, d, node)
            p = (b + 4 * (sum(votes) + 4 * p) / (len(votes) + 4)) / (n + 4)
        pure[host, at[-1]] = p
    return {k: (at[-1], pure[k[0], at[-1]]) for k, at in trees.items()}


def test_tree_against_brute_force(spark):
    """On the query's own table: the method decides by its labels, and some pages that no rule fits are blocked."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = urls.judge(pages).collect()
    rows = []
    for r in got:
        fit = max(((len(t), say) for say, t in urls.RULES for h, p in [t.split("/", 1)] if (r["host"] == h or r["host"].endswith("." + h)) and r["path"].startswith("/" + p)), default=None)
        rows.append((r["host"], r["path"], fit and fit[1] == "block"))
    want = brute_tree(rows)
    assert len(got) == pages.count()
    by_template = {(h, t): p for (h, _), (t, p) in want.items()}
    for r in got:
        assert math.isclose(r["purity"], by_template[r["host"], r["template"]], rel_tol=1e-9)
        if r["rule"] is None:
            assert r["verdict"] == ("block" if r["purity"] > urls.REJECT else "allow")
    free = {r["verdict"] for r in got if r["rule"] is None}
    assert free == {"allow", "block"}


def test_deep_paths_differ(spark):
    rows = [(i, f"http://h.org/a/b/c/d/e/f/g{i % 2}/x", bool(i % 2)) for i in range(60)] + [(100 + i, f"http://h.org/a/b/c/d/e/g/{w}", None) for i, w in enumerate("xy")]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, bad boolean"), (), F.col("bad")).collect()}
    assert got[0]["template"] == "/a/b/c/d/e/f/g{n}/x" and got[100]["template"] == "/a/b/c/d/e/g/x"


def test_many_literals_become_a_wildcard(spark):
    words = ["".join(chr(97 + (i // 26**k) % 26) for k in range(3)) for i in range(200)]
    df = spark.createDataFrame([(i, f"http://h.org/u/{w}") for i, w in enumerate(words)], "page_id long, url string")
    assert {r["template"] for r in urls.judge(df, ()).collect()} == {"/u/{s}"}


def test_slugs_with_digits_become_a_wildcard(spark):
    rows = [(i, f"http://h.org/p/slug{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}-{i}/x") for i in range(400)]
    rows += [(1000 + i, f"http://h.org/q/{i}/x") for i in range(400)] + [(2000 + i, f"http://h.org/r/{i:x}{i:015x}.html") for i in range(400)] + [(3000, "http://h.org/r/word{1}-{n}.html")]
    got = {r["page_id"]: r["template"] for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), ()).collect()}
    assert {got[i] for i in range(400)} == {"/p/{s}/x"} and {got[1000 + i] for i in range(400)} == {"/q/{n}/x"}
    assert len({got[2000 + i] for i in range(400)} | {got[3000]}) <= 3


ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_base(text):
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_secrets(spark, odd, odd_rows, none):
    rng = random.Random(4)
    extra = ["password = 'hunter22'", "Token:abc api-key=x API_KEY = \"abcdefgh\"", "AKIA" + "Z9" * 8, "AKIAAKIA" + "Q" * 11, "é" * 5 + "0123456789abcdef" * 2, "ſecret=longvalue", "secret=token:abcdefgh"]
    extra += ["".join(rng.choice("passwordtokn =:\"'abcdef0123456789AKI ") for _ in range(200)) for _ in range(200)]
    for t in extra + [t or "" for _, t in odd_rows]:
        assert [s for s in secrets.scan(t) if s[0] != "entropy"] == brute_base(t)
    got = secrets.find_secrets(odd).collect()
    assert len(got) == len(odd_rows)
    assert {r["base_sha256"] for r in got} == {hashlib.sha256(b"").hexdigest()}
    assert secrets.find_secrets(none).count() == 0


def test_entropy_windows():
    rng = random.Random(6)
    s = "".join(rng.choice("abcdef0123456789+/") for _ in range(80))
    for i, h in enumerate(secrets.window_entropies(s)):
        counts = Counter(s[i : i + secrets.WINDOW]).values()
        assert math.isclose(h, -sum(n / secrets.WINDOW * math.log2(n / secrets.WINDOW) for n in counts), abs_tol=1e-9)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    assert secrets.entropy_spans(f"see {key} there")
    for harmless in ("123e4567-e89b-12d3-a456-426614174000", "abcdefghijklmnopqrstuvwxyz0123456789", "some-long-file-name-with-words-2024", "a" * 60):
        assert not secrets.entropy_spans(f"see {harmless} there")
    assert secrets.redact(f"a {key} b") == "a [entropy] b"


def edit_distance_within(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_alignment_against_full_matrix():
    rng = random.Random(8)
    for _ in range(60):
        p = [rng.choice("abcd") for _ in range(rng.randint(20, 60))]
        q = list(p)
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(q))
            q[k : k + 1] = rng.choice([[], ["x"], [q[k], "y"]])
        text = "".join(rng.choice("abcd") for _ in range(6)) + "".join(q) + "".join(rng.choice("abcd") for _ in range(6))
        e, _ = decontaminate.alignment(decontaminate.codes("".join(p)), decontaminate.codes(text), 2, 30)
        assert e == edit_distance_within("".join(p), text)


def test_leaks(spark, odd, none):
    rng = random.Random(9)
    items = [" ".join(f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randint(0, 99)}" for _ in range(rng.randint(20, 90))) for _ in range(12)]
    rows, want = [], set()
    for i in range(60):
        text = " ".join(f"w{rng.randint(0, 999)}" for _ in range(100))
        if i % 3 == 0:
            k = rng.randrange(12)
            p = list(decontaminate.normal(items[k]))
            for _ in range(int(decontaminate.EDITS * min(len(p), 256)) // 2):
                a = rng.randrange(len(p))
                p[a : a + 1] = rng.choice([[], ["x"], [p[a], "y"]])
            text = f"{text}\n{''.join(p).upper()}  {text}"
            want.add((i, k))
        rows.append((i, text))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items), (50, None), (51, ""), (52, "short")], "item_id long, text string")
    got = decontaminate.leaks(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs.withColumn("index", F.lit(1)), bench).collect()) == [i for i in range(60) if i % 3]
    assert decontaminate.leaks(none, bench).count() == 0
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.leaks(odd, bench).count() == 0
    assert decontaminate.clean(odd, bench).columns == odd.columns


def test_qgram_hashes_are_position_free():
    x = decontaminate.codes("abcdefghijklmnopqrstabcdefghijklmnopqrst")
    h = decontaminate.qgrams(x)
    assert len(h) == len(x) - decontaminate.Q + 1
    assert (h[:11] == h[20:31]).all() and len(np.unique(h)) == 20


def test_excerpts_and_changed_words_leak(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwy") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [prose(rng.randint(40, 60)) for _ in range(10)]
    rows, want = [], set()
    for k, item in enumerate(items):
        for share in (0.9, 0.7, 0.5):
            size = int(len(item) * share)
            a = rng.randint(0, len(item) - size)
            want.add((len(rows), k))
            rows.append((len(rows), f"{prose(40)} {item[a : a + size]} {prose(40)}"))
        for share in (0.05, 0.1):
            words = item.split()
            for i in rng.sample(range(len(words)), round(share * len(words))):
                words[i] = word()
            want.add((len(rows), k))
            rows.append((len(rows), f"{prose(40)} {' '.join(words)} {prose(40)}"))
        rows.append((len(rows), prose(150)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()} == want
    assert {r["doc_id"] for r in decontaminate.clean(docs, bench).collect()} == {i for i, _ in rows} - {i for i, _ in want}


def test_short_items_leak_exactly(spark):
    docs = spark.createDataFrame([(0, "He asked: What  is\n2 + 2? Nobody knew."), (1, "what is 2 + 3?"), (2, "somewhat is 2 + 2?"), (3, "問題は東京都の人口です"), (4, ""), (5, "what is 2 + 2?")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "What is 2 + 2?"), (8, "東京都"), (9, " "), (10, "what is 2 + 2?")], "item_id long, text string")
    got = decontaminate.leaks(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"], r["start"]) for r in got} == {(0, 7, 10), (0, 10, 10), (3, 8, 3), (5, 7, 0), (5, 10, 0)}
    assert {r["doc_id"] for r in decontaminate.clean(docs, bench).collect()} == {1, 2, 4}


def test_items_without_an_id(spark):
    rng = random.Random(21)
    item, other, short = (" ".join(f"{rng.choice('bcdfg')}{rng.randint(0, 999)}" for _ in range(n)) for n in (30, 40, 4))
    docs = spark.createDataFrame([(1, f"x {item} y"), (2, f"{other}, {short}"), (3, "clean"), (None, f"{item} {other}")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, item), (None, other), (None, short), (5, item), (None, None)], "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()), key=str)
    assert got == sorted([(1, None), (1, 5), (2, None), (None, None), (None, 5)], key=str)
    assert [r["doc_id"] for r in decontaminate.clean(docs, bench).collect()] == [3]


def test_many_hits_are_taken_in_parts(monkeypatch):
    rng = random.Random(13)
    item = " ".join(f"{rng.choice('bcdfg')}{rng.randint(0, 999)}" for _ in range(60))
    texts = [f"x {item[i : i + 150]}" for i in range(40)]
    index = decontaminate.Index.build([(1, item)])
    whole = index.matches(texts)
    assert {m[0] for m in whole} == set(range(40))
    monkeypatch.setattr(decontaminate, "_HITS", 100)
    assert index.matches(texts) == whole


def test_keys_joined_to_runs_are_found():
    rng = random.Random(16)
    for rule in ("=" * 40, "_" * 40, "0123456789" * 5):
        for _ in range(20):
            key = "".join(rng.sample("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 29)) + "7"
            for text, a in ((rule + key, len(rule)), (key + rule, 0)):
                spans = secrets.entropy_spans(f"see {text} there")
                assert spans and spans[0][0] <= a + 4 and spans[-1][1] >= a + 4 + len(key)
                assert key not in secrets.redact(text)
    for harmless in ("=" * 80 + "123e4567-e89b-12d3-a456-426614174000", "_" * 60 + "some-long-file-name-2024" + "_" * 60, "=" * 40 + "0123456789" * 4):
        assert not secrets.entropy_spans(f"see {harmless} there")
