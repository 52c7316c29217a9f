"""The operators on documents against brute force, and on odd and empty tables."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import text, with_clashes
from tidefold.llm import _words, decontaminate, line_dedup, mixing, ngram_join, quality_crf, quality_rules, secrets
from tidefold.llm._shared import Tables, components, shared_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


# words


def test_word_hashes_are_those_of_words():
    rng = random.Random(3)
    texts = ["".join(rng.choice("aB\tc é\n\x0b語Z ") for _ in range(rng.choice([0, 1, 5, 50]))) for _ in range(500)]
    texts += [None, "", "x" * 200_000 + " b " + "c" * 150_000, "a b " * 60_000]
    seen = {}
    for i, h in _words.by_text(pa.array(texts)):
        expected = words(texts[i])
        assert len(h) == len(expected)
        for w, x in zip(expected, h.tolist(), strict=True):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


# components


def test_components_match_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)] + [(k, k + 1) for k in range(1000, 1040)] + [(2000, 2000 + k) for k in range(60)] + [(7, 7)]
    p = {}

    def find(x):
        p.setdefault(x, x)
        while p[x] != x:
            x = p[x]
        return x

    for a, b in edges:
        u, v = find(a), find(b)
        p[max(u, v)] = min(u, v)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), Tables(spark, "t")).collect()}
    alone = {x for x in p if all(x not in e or e[0] == e[1] for e in edges)}
    assert got == {x: find(x) for x in p if x not in alone}


def test_shared_folder_is_the_sessions(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


# 5: n-gram join


def shingles(t):
    w = words(t)
    return frozenset([tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else [])


def brute_classes(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    p = {d: d for d, _ in sets if d is not None}

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for i, (d, s) in enumerate(sets):
        for e, u in sets[:i]:
            if s and u and d is not None and e is not None and 100 * len(s & u) >= 80 * len(s | u):
                a, b = find(d), find(e)
                p[max(a, b)] = min(a, b)
    return Counter((d, len(s), None if d is None else find(d)) for d, s in sets)


def as_classes(df):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())


def near_copies(seed, groups, each):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = text(seed * 1000 + g, rng.randint(20, 150)).split()
        for _ in range(each):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,groups,each", [(1, 30, 3), (2, 3, 40)])
def test_join_finds_every_link(spark, seed, groups, each):
    rows = near_copies(seed, groups, each)
    got = as_classes(ngram_join.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))
    assert got == brute_classes(rows)


def test_join_finds_links_of_documents_that_the_first_of_the_bucket_rules_out(spark):
    # b is no link of a, c is too long to be compared with a, and what b and c share outside a is a passage too common to lie in a prefix
    common, rows = text(70_000, 24)[:-1], []
    for g in range(12):
        core, own = text(80_000 + g, 109)[:-1], text(90_000 + g, 16)[:-1].split()
        rows += [(3 * g, f"{core} {' '.join(own[:5])}"), (3 * g + 1, f"{core} {own[5]} {common}"), (3 * g + 2, f"{core} {' '.join(own[6:])} {common}")]
    got = as_classes(ngram_join.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute_classes(rows) and sum(k for (d, _, c), k in got.items() if c == d - 1) == 12


def test_join_on_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    assert as_classes(ngram_join.similarity_classes(odd_docs)) == brute_classes(rows)
    assert ngram_join.similarity_classes(no_docs).count() == 0


def test_join_one_id_with_two_texts_links_both(spark):
    a, b = text(1, 40), text(2, 40)
    rows = [(5, a), (5, b), (3, a), (4, b), (9, text(3, 40))]
    got = {(r["doc_id"], r["component_id"]) for r in ngram_join.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 3), (3, 3), (4, 3), (9, 9)}


def test_join_frees_the_shuffle_files_of_its_tables(spark, monkeypatch):
    rows = [(i, text(60_000 + i, 300)) for i in range(400)]
    disk, keep, left = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager(), Tables.keep, []

    def shuffled():
        files = disk.getAllFiles()
        return {f.getName(): f.length() for f in map(files.apply, range(files.size())) if f.getName().startswith("shuffle")}

    def watched(self, *given):
        out = keep(self, *given)
        for _ in range(30):
            # the prefixes alone are 400 * 60 shingles of 8 random bytes
            if (n := sum(n for name, n in shuffled().items() if name not in before)) < 100_000:
                left.append(n)
                return out
            time.sleep(0.1)  # files go a little after the query
        pytest.fail("the shuffle files of a table that is written are still there")

    docs, before = spark.createDataFrame(rows, "doc_id long, text string"), shuffled()
    monkeypatch.setattr(Tables, "keep", watched)
    assert ngram_join.similarity_classes(docs).count() == 400
    assert len(left) > 10


def test_join_verifies_many_pairs_in_several_runs(spark, monkeypatch):
    rows, runs, verify = near_copies(2, 3, 40), [], ngram_join._verify
    monkeypatch.setattr(ngram_join, "_verify", lambda *given: runs.append(most) or verify(*given))
    for most in (1000, 10):
        monkeypatch.setattr(ngram_join, "PAIRS", most, raising=False)
        assert as_classes(ngram_join.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_classes(rows)
    assert runs.count(10) > runs.count(1000) > 0


def test_join_sums_the_sketches_of_all_tasks(spark):
    rows = [(i, text(50_000 + i % 7, 40)) for i in range(700)] + [(1000 + i, text(i, 30)) for i in range(50)]
    run, schema = ngram_join._sizes(5, 22)
    both = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).mapInArrow(run, schema)
    got = ngram_join._sketch(both.where("kind = 1").select("doc_id", "n", "sig"), Tables(spark, "t"), 22)
    want = np.zeros(1 << 22, dtype=np.int64)
    for _, h in _words.by_text(pa.array([t for _, t in rows])):
        np.add.at(want, (_words.shingle_set(h, 5) >> np.uint64(42)).astype(np.int64), 1)
    assert (got == want).all() and got.max() >= 100
    pieces = [(k, c) for k, c in enumerate((np.arange(9), np.full(9, 300), np.zeros(9, np.int64), np.full(9, 70_000), np.full(9, 1 << 40)))]
    at, width, packed = (x.to_pylist() for x in ngram_join.pieces(iter(pieces)))
    assert at == [0, 1, 3, 4] and all((ngram_join.unpacked(w, x) == pieces[k][1]).all() for k, w, x in zip(at, width, packed, strict=True))


def test_signature_bounds_the_overlap():
    rng = np.random.default_rng(1)
    for n, m, common in ((10, 12, 8), (100, 120, 90), (500, 400, 0), (1000, 900, 850)):
        both = np.unique(rng.integers(0, 1 << 63, n + m, dtype=np.uint64))
        x, y = np.sort(both[:n]), np.sort(np.concatenate([both[:common], both[n : n + m - common]]))
        assert ngram_join.at_most(ngram_join.signature(x), ngram_join.signature(y), len(x), len(y)) >= len(np.intersect1d(x, y))


# 7: quality rules


def brute_rules(t):
    w, lines = WORD.findall(t or ""), (t or "").split("\n")
    seen = defaultdict(list)
    for i in range(len(w) - 7):
        seen[tuple(w[i : i + 8])].append(i)
    covered = {k for at in seen.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    full = [x for x in lines if WORD.search(x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(full) - len(set(full)), len(covered), failed)


def test_rules_base_counts(spark, odd_docs, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    rep = "a b c d e f g h " * 3 + text(3, 50) + "\nsame line.\nsame line.\n\n" + " ".join("xyz" for _ in range(30))
    docs = docs.unionByName(spark.createDataFrame([(900, rep)], "doc_id long, text string"))
    expected = Counter((r["doc_id"], *brute_rules(r["text"])) for r in docs.collect())
    got = quality_rules.judge(docs).collect()
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == expected
    assert not any(r["kept"] and r["base_failed"] for r in got)


@pytest.mark.parametrize(
    "line",
    ["word*** other%%% more&&&", "ALL OF THIS IS SHOUTED, EVERY WORD!", "Home | News | Sport | About | Contact us", "Main menu", "All rights reserved by the owner.", "buy now buy now buy now buy now", " ".join(f"w{i}" for i in range(50))],
)
def test_failing_lines_go(spark, line):
    good = text(4, 60)
    rows = spark.createDataFrame([(1, f"{good}\n{line}\n{text(5, 60)}"), (2, f"{good[:40]}\n" + "\n".join([line] * 40))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality_rules.judge(rows, text=True).collect()}
    assert got[1]["kept"] and got[1]["n_failed_lines"] == 1 and line not in got[1]["text"] and good in got[1]["text"]
    assert not got[2]["kept"]


def test_rules_on_no_rows(no_docs):
    assert quality_rules.judge(no_docs, text=True).count() == 0


# 4: line dedup


def brute_lines(rows, sites=8, most=100):
    trim = lambda x: x.strip(" \t\n\v\f\r")
    on = defaultdict(set)
    for _, t, s in rows:
        for x in (t or "").split("\n"):
            on[trim(x)].add(s)
    common = {x for x, s in on.items() if x and len(s) >= sites}
    out = Counter()
    for d, t, _ in rows:
        lines = [] if t is None else t.split("\n")
        cut = [trim(x) for x in lines if trim(x) in common]
        whole = 100 * sum(map(len, cut)) > most * sum(len(trim(x)) for x in lines)
        cut = [] if whole else cut
        out[d, t if whole or t is None else "\n".join(x for x in lines if trim(x) not in common), sum(trim(x) != "" for x in lines), len(cut), sum(map(len, cut))] += 1
    return out


def test_line_dedup_is_exact(spark, odd_docs, no_docs):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        lines = [text(5000 + 7 * i + k, 12) for k in range(5)]
        for k in range(14):  # line k stands on about k sites
            if i % 14 >= 14 - k and rng.random() < 0.5:
                lines.insert(rng.randrange(len(lines)), f"  shared line {k}.\t" if rng.random() < 0.3 else f"shared line {k}.")
        rows.append((i, "\n".join(lines), f"site{i % 14}" if i % 14 else None))
    rows += [(1000 + k, "copied first line here.\ncopied second line here.", f"site{k % 14}") for k in range(30)]
    odd = [(r["doc_id"], r["text"], r["source"]) for r in odd_docs.select("doc_id", "text", "source").collect()]
    docs = with_clashes(spark.createDataFrame(rows + odd, "doc_id long, text string, source string"))
    as_rows = lambda df: Counter((r["doc_id"], r["text"], r["n_lines"], r["n_removed"], r["removed_chars"]) for r in df.collect())
    got = as_rows(line_dedup.clean(docs))
    assert got == brute_lines(rows + odd)
    assert as_rows(line_dedup.clean(docs, most_percent=80)) == brute_lines(rows + odd, most=80) != got
    assert any(t == "" and n for _, t, _, n, _ in got)  # short carriers are cleaned too
    assert sum(k[3] for k in got) > 0
    assert line_dedup.clean(no_docs).count() == 0
    # many lines, all of them shared, and a row that is repeated often
    long = "\n".join(f"line {k} of a long document" for k in range(40_000))
    many = [(k, long, f"s{k}") for k in range(8)] + [(9, long[:300], "s1")] * 200 + [(10, f"own\n{long}\n own \n\nlast", "s2")]
    assert as_rows(line_dedup.clean(spark.createDataFrame(many, "doc_id long, text string, source string"))) == brute_lines(many)


# 6: secrets

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_base(t):
    t = t or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return [sum(x[1] == k for x in found) for k in range(3)], ",".join(f"{x[3]}:{x[0]}:{x[2]}" for x in sorted(found))


KEY = "AKIA" + "ABCD1234EFGH5678"
WEAK = "Zk9xQw3rTy7uIo1pAs5dFg8h"


def test_secrets_base(spark, odd_docs, no_docs):
    rng = random.Random(2)
    bits = ["token=abc", "token: token:", "PassWord = 'hunter2x'", "api-key=1", "api_key=ABC.def/1+2==", KEY, "AKIA12", "AKIAAKIA" + "X" * 20, "0123456789abcdef" * 2, "deadbeef", "é語", "\n", " ", "secret", "=", "token=token=abcdefgh", '"token":"abcdefgh"', "user=alice", "https://h.example/x"]
    rows = [(i, "".join(rng.choice(bits) + rng.choice([" ", "", "."]) for _ in range(rng.randint(0, 12)))) for i in range(300)]
    rows += [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))
    expected = Counter()
    for d, t in rows:
        n, s = brute_base(t)
        expected[(d, *n, hashlib.sha256(s.encode()).hexdigest())] += 1
    got = secrets.scan(docs).collect()
    assert Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got) == expected
    for r in got:  # all base spans stay
        assert sum(x.split(":")[0] in ("assign", "access", "hex") for x in r["spans"].split(",")) == r["n_assign"] + r["n_access"] + r["n_hex"]
    assert secrets.scan(no_docs).count() == 0


@pytest.mark.parametrize(
    "t,kinds",
    [
        (f"user = alice01 and then {WEAK} here", {"identifier", "secret"}),
        (f"just {WEAK} alone", set()),
        ("user = alice01 alone", set()),
        (f"user = alice01 {'word ' * 80}{WEAK}", set()),
        (f"go to https://db.example.org/x with {WEAK}", {"endpoint", "secret"}),
        (f"{KEY} {WEAK}", {"access", "secret"}),
        ("see https://docs.example.org/page for more", set()),
        ("db.example.org:5432 password=hunter22", {"endpoint", "assign"}),
    ],
)
def test_weak_parts_need_each_other(spark, t, kinds):
    got = secrets.scan(spark.createDataFrame([(1, t)], "doc_id long, text string")).first()
    spans = [x.split(":") for x in got["spans"].split(",") if x]
    assert {x[0] for x in spans} == kinds
    assert all(t[int(a) : int(b)].strip() == t[int(a) : int(b)] for _, a, b in spans)


def test_interval_join_is_exact_at_the_edges(spark):
    rows = [(i, " " * pad + "user = alice01" + " " * gap + WEAK) for i, (pad, gap) in enumerate((p, g) for p in (0, 100, 250, 500) for g in (1, 230, 241, 242, 243, 260))]
    for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        t = rows[r["doc_id"]][1]
        near = t.index(WEAK) - t.index("user") <= secrets.SCOPE
        assert bool(r["spans"]) == near


def brute_spans(t):
    """All spans of a text, candidates against candidates."""
    base = [(m.start(), m.end(), k) for k, found in enumerate(([m for m in ASSIGN.finditer(t) if len(m[1]) >= 6], [m for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20], [m for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24])) for m in found]
    weak = [(m.start(), m.end(), 3) for m in re.finditer(secrets.IDENTIFIER, t, re.ASCII)]
    weak += [(m.start(), m.end(), 4) for m in re.finditer(secrets.SECRET, t) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
    for m in re.finditer(r"""https?://[^\x20\x09-\x0D"'<>]+|(?<![a-z0-9.-])([a-z0-9.-]+):([0-9]+)""", t):
        if not m[1] or ("." in m[1] and all(m[1].split(".")) and 2 <= len(m[2]) <= 5):
            weak.append((m.start(), m.end(), 5))
    covered = np.zeros(len(t) + 1, bool)
    for a, b, _ in base:
        covered[a:b] = True
    parts = base + [x for x in weak if not covered[x[0] : x[1]].any()]
    side = {k: np.sort([x[0] for x in parts if (x[2] in (0, 2, 4)) == k]) for k in (True, False)}
    near = lambda x: np.searchsorted(side[x[2] != 4], x[0] + secrets.SCOPE, "right") > np.searchsorted(side[x[2] != 4], x[0] - secrets.SCOPE, "left")
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, b, k in sorted((x for x in parts if x[2] < 3 or near(x)), key=lambda x: (x[0], x[2], x[1])))


def test_scan_of_very_long_texts(spark):
    n, rng = 1_700_000, random.Random(9)
    head, bits = "token=abcdef12345 host:8080 ", ["user=al", "db.example.org:5432", "a..b:99", "x.y:1", "x.y:123456", WEAK, "word " * 60, "deadbeef" * 3, "token=abcdef9", KEY, "https://h/é", "-.a.b:77", "q.r:80.s.t:90:91"]
    rows = [head + "a." * n, head + "Ab1+" * n, head + "0f" * n, head + "a.b:" * 20_000, "".join(rng.choice(bits) + rng.choice(" ;\n") for _ in range(200_000)), "a." * 50 + ":80 " + WEAK, f"{WEAK} a.b:8080/ .c.d:80 e.f.:80"]
    got = {r["doc_id"]: r for r in secrets.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    for i, t in enumerate(rows):
        assert got[i]["spans"] == brute_spans(t)


# 8: decontamination


def test_leaks_with_substitutions(spark, odd_docs, no_docs):
    items = [(i, text(300 + i, 20 + i)) for i in range(10)] + [(20, "exactly five words stand here"), (21, "two words"), (22, ""), (23, None), (24, text(300, 20))]
    docs, planted = [], set()
    rng = random.Random(4)
    for i in range(60):
        w = text(900 + i, 200).split()
        if i < 30:
            part = words(items[i % 10][1])
            for _ in range(i % 3):
                part[rng.randrange(len(part))] = "substituted"
            at = rng.randrange(150)
            w[at:at] = part
            planted.add((i, i % 10))
            if i % 10 == 0:
                planted.add((i, 24))
        elif i < 40:
            w[10:10] = words(items[i % 10][1])[:7]
        docs.append((i, " ".join(w)))
    docs.append((100, "x Exactly FIVE words stand HERE y"))
    planted.add((100, 20))
    got = decontaminate.leaks(with_clashes(spark.createDataFrame(docs, "doc_id long, text string")), with_clashes(spark.createDataFrame(items, "item_id long, text string"))).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == planted
    assert all(r["n_matched"] * 5 >= 4 * r["n_aligned"] for r in got)
    assert decontaminate.leaks(odd_docs, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontaminate.leaks(no_docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert decontaminate.leaks(odd_docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def brute_leaks(docs, items):
    """All alignments of all pairs, without seeds."""
    out = {}
    for d, t in docs:
        x = words(t)
        for i, u in items:
            y = words(u)
            if len(y) < decontaminate.LEAST:
                continue
            for shift in range(1 - len(y), len(x)):
                a, b = max(0, -shift), min(len(y), len(x) - shift)
                m, s, e = decontaminate.best_stretch(np.array([x[j + shift] == y[j] for j in range(a, b)], bool))
                if m >= min(decontaminate.MATCHED, -(-4 * len(y) // 5)):
                    out[d, i] = max(out.get((d, i), ()), (m, s - e, -(a + s + shift), -(a + s)))
    return {(*k, m, -n, -d, -i) for k, (m, n, d, i) in out.items()}


def test_leaks_are_those_of_all_alignments(spark):
    rng, items = random.Random(12), []
    for n in [*range(5, 26), 30, 80, 200]:
        items.append((n, " ".join(f"w{rng.randrange(40)}" for _ in range(n))))
    docs = []
    for k in range(150):
        n, t = items[k % len(items)]
        w = t.split()
        for j in rng.sample(range(n), min(n, rng.choice([n // 5, n // 5, n // 4, 2 + n // 3]))):
            w[j] = f"x{j}"
        a = rng.choice([0, 0, 1, n // 3])
        docs.append((k, " ".join([f"w{rng.randrange(40)}" for _ in range(rng.choice([0, 3, 30]))] + w[a:] + [f"w{rng.randrange(40)}" for _ in range(rng.choice([0, 20]))])))
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    expected = brute_leaks(docs, items)
    assert {tuple(r) for r in got} == expected and len({i for _, i, *_ in expected}) > 18


def test_masks_lose_no_placement_of_substitutions():
    import itertools

    for n in range(5, 25):
        kinds = [np.array([x == "1" for x in m]) for m in decontaminate.masks_for(n)]
        for missing in itertools.combinations(range(n), n - min(n, -(-4 * n // 5)) if n > 9 else 1):
            same = np.ones(n, bool)
            same[list(missing)] = False
            assert any(same[s : s + len(m)][m].all() for m in kinds for s in range(n - len(m) + 1)), (n, missing)


def test_best_stretch():
    assert decontaminate.best_stretch(np.array([0, 1, 1, 1, 0, 0, 1], bool)) == (3, 1, 4)
    assert decontaminate.best_stretch(np.array([1] * 5 + [0] + [1] * 5, bool)) == (10, 0, 11)
    assert decontaminate.best_stretch(np.zeros(3, bool)) == (0, 0, 0)


# 2: mixing


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, held = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in held)
        free = sum(weight[s] for s in order if s not in held)
        out = {s: 3.0 * sizes[s] if s in held else left * weight[s] / free for s in order}
        over = {s for s in order if s not in held and out[s] > 3 * sizes[s]}
        if not over:
            return out
        held |= over


def test_mixing_meets_targets(spark, odd_docs, no_docs):
    rng = random.Random(6)
    rows = [(i, text(i, rng.choice([5, 40, 400])), rng.choice(["a", "b", "b", "b", "c", "d", None, "é"])) for i in range(400)] + [(1000, text(1, 3), "tiny"), (1001, "", "void"), (1002, None, None)]
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    n = {d: len(WORD.findall(t or "")) for d, t, _ in rows}
    sizes = Counter()
    for d, _, s in rows:
        sizes[s] += n[d]
    expected, source, taken = brute_targets(sizes), {d: s for d, _, s in rows}, Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == n[r["doc_id"]] and r["source_size"] == sizes[s] and r["target"] == pytest.approx(expected[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s, x in expected.items():
        assert taken[s] == pytest.approx(x, rel=0.03, abs=6)
    assert len(got) == len(rows)
    assert mixing.mix(odd_docs).count() == odd_docs.count()
    assert mixing.mix(no_docs).count() == 0


def test_seats_are_those_of_the_highest_quotients(spark):
    rng, rows = random.Random(11), []
    for g in range(40):
        rows += [(g, k, rng.choice([0.0, 0.4, 0.5, 1.4, 2.45, 30.4, 1000.4, 9.45, 77.55, rng.random() * 20])) for k in range(rng.choice([1, 3, 12, 60]))]
    got = {(r["g"], r["t"]): r["q"] for r in mixing.apportioned(spark.createDataFrame(rows, "g long, t long, x double"), "g", "x", "t").collect()}
    assert len(got) == len(rows)
    for g in range(40):
        mine = [(t, x) for h, t, x in rows if h == g]
        house, seats = int(sum(int(x * 1_000_000 + 0.5) for _, x in mine) / 1_000_000 + 0.5), Counter()
        for _ in range(house):
            best = max(mine, key=lambda c: (c[1] / (2 * seats[c[0]] + 1), -c[0]))
            seats[best[0]] += 1
        assert sum(got[g, t] for t, _ in mine) == house
        worst = max(x / (2 * got[g, t] + 1) for t, x in mine)  # no seat that was not given has a higher quotient than one that was
        assert all(got[g, t] == 0 or x / (2 * got[g, t] - 1) >= worst - 1e-12 for t, x in mine)


def test_mixing_over_many_shards(spark):
    rows = [(i, text(i, 50), "ab"[i % 2]) for i in range(600)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), shard_words=700).collect()
    by = defaultdict(lambda: [0, 0.0])
    for r in got:
        by[r["target"]][0] += r["taken"]
    assert all(x[0] == pytest.approx(t, rel=0.01) for t, x in by.items())


# 1: quality classifier


def test_crf_gradient_and_marginals():
    rng = np.random.default_rng(2)
    text_of = np.array([0, 0, 0, 1, 2, 2])
    u, trans = rng.normal(size=6), rng.normal(size=(2, 2))
    m, expected = quality_crf.forward_backward(u, trans, text_of, pairs=True)
    for c in range(3):
        at = np.flatnonzero(text_of == c)
        n, z, mine, pair = len(at), 0.0, np.zeros(len(at)), np.zeros((2, 2))
        for k in range(2**n):
            y = [(k >> i) & 1 for i in range(n)]
            p = np.exp(sum(u[at[i]] * y[i] for i in range(n)) + sum(trans[y[i], y[i + 1]] for i in range(n - 1)))
            z += p
            mine += p * np.array(y)
        assert np.allclose(m[at], mine / z)
    assert np.isclose(expected.sum(), 3)


def test_classifier_on_held_out_and_odd_rows(spark, odd_docs, no_docs):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_crf.train(docs, labels)
    got = {r["doc_id"]: r for r in quality_crf.score(docs, model).collect()}
    wrong = 0
    for r in labels.collect():
        if r["quality"] is not None and got[r["doc_id"]]["held_out"]:
            wrong += got[r["doc_id"]]["predicted"] != r["quality"]
    assert wrong <= 3
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for d, r in got.items())
    odd = quality_crf.score(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in odd) and not any(r["held_out"] for r in odd if r["doc_id"] is None)
    assert quality_crf.score(no_docs, model).count() == 0
    blind = quality_crf.train(docs, labels.limit(0))
    assert {r["score"] for r in quality_crf.score(odd_docs, blind).collect()} == {0.5}


def test_a_very_long_text_keeps_no_other_out_of_the_sample(spark, monkeypatch):
    ids = spark.range(60).where(quality_crf.fold(F.col("id")) != 0).orderBy(F.xxhash64("id"), "id").collect()
    ids = [r["id"] for r in ids]
    sizes = {d: 50_000 if k == 0 else 9_000 if k == 1 else 40 for k, d in enumerate(ids)}
    docs = spark.createDataFrame([(d, "x" * n) for d, n in sizes.items()], "doc_id long, text string")
    labels = spark.createDataFrame([(d, k % 2) for k, d in enumerate(ids)], "doc_id long, quality int")
    monkeypatch.setattr(quality_crf, "fit", lambda texts, y, good: Counter((len(t), q) for t, q in zip(texts, y, strict=True)))
    got = quality_crf.train(docs, labels, train_bytes=20_000)
    assert got == Counter((sizes[d], k % 2) for k, d in enumerate(ids) if sizes[d] <= 9_000)


def plain_features(line):
    """The features of a line, by character."""
    w, n = words(line), len(words(line))
    data = (line + "\n").encode()
    upper = sum(c.isascii() and c.isupper() or "À" <= c <= "Þ" for c in line)
    lower = sum(c.isascii() and c.islower() or "ß" <= c <= "ÿ" for c in line)
    count = lambda marks: sum(line.count(c) for c in marks)
    size, one, symbols = len(data), max(len(line.encode()) - count(" \t\v\f\r"), 1), count("#*$%&|<>=_~^\\/{}[]+@`")
    distinct, letters = len(set(w)), upper + lower
    twice = sum(a == b for a, b in zip(w, w[1:], strict=False))
    return [1, np.log1p(n) / 4, np.log1p(size) / 6, upper / max(letters, 1), sum(c in "0123456789" for c in line) / one * 4, count(".,;:?!'\"()-") / n, min(symbols / n, 2), symbols > 0.3 * n, upper > 0.6 * letters, one / n / 8, distinct / n, min(twice / n * 4, 1), distinct < 0.4 * n and n >= 8, min(count(".?!") / n * 4, 2)]


def test_scores_by_their_definition(spark):
    """Whole scores: every labelling of a text's lines, its weight, and the words of the lines labelled good."""
    rng = np.random.default_rng(4)
    model = quality_crf.Model(rng.normal(size=42), rng.normal(size=(2, 2)), 3.0, -1.0)
    bits = ["A line, of words.", "BUY NOW!!! $$$ %%%", "été Été à 12 34", "same same same same same same same same same", "", "  ", "x | y | z", "(ok) - \"fine\"?"]
    texts = ["\n".join(rng.choice(bits, rng.integers(0, 8))) + "\n" for _ in range(60)] + ["", " \n "]
    got = {r["doc_id"]: r["score"] for r in quality_crf.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for d, t in enumerate(texts):
        lines = [x for x in t.split("\n") if words(x)]
        x = np.array([plain_features(k) for k in lines], float).reshape(len(lines), 14)
        zero, q, z = np.zeros((1, 14)), 0.0, 0.0
        u = np.concatenate([x, np.concatenate([zero, x])[: len(x)], np.concatenate([x, zero])[1:]], axis=1) @ model.weights if len(x) else []
        size = [len(words(k)) for k in lines]
        for k in range(2 ** len(lines) if lines else 0):
            y = [(k >> i) & 1 for i in range(len(lines))]
            p = np.exp(sum(a * b for a, b in zip(u, y, strict=True)) + sum(model.trans[a, b] for a, b in zip(y, y[1:], strict=False)))
            z, q = z + p, q + p * sum(a * b for a, b in zip(size, y, strict=True)) / sum(size)
        assert got[d] == pytest.approx(1 / (1 + np.exp(-(3 * (q / z if z else 0) - 1))), abs=1e-9)


def test_gradient_of_the_likelihood():
    rng = np.random.default_rng(7)
    text_of, y = np.array([0, 0, 0, 1, 2, 2]), np.array([1, 0, 1, 0, 1, 1])
    u, trans = rng.normal(size=6), rng.normal(size=(2, 2))

    def likelihood(u, trans):
        out = 0.0
        for c in range(3):
            at = np.flatnonzero(text_of == c)
            weigh = lambda s: sum(u[i] * a for i, a in zip(at, s, strict=True)) + sum(trans[a, b] for a, b in zip(s, s[1:], strict=False))  # noqa: B023,E731
            out += weigh(list(y[at])) - np.log(sum(np.exp(weigh([(k >> i) & 1 for i in range(len(at))])) for k in range(2 ** len(at))))
        return out

    m, expected = quality_crf.forward_backward(u, trans, text_of, pairs=True)
    same = text_of[1:] == text_of[:-1]
    for i in range(6):
        e = np.eye(6)[i] * 1e-6
        assert (likelihood(u + e, trans) - likelihood(u - e, trans)) / 2e-6 == pytest.approx(y[i] - m[i], abs=1e-6)
    for s in (0, 1):
        for r in (0, 1):
            e = np.zeros((2, 2))
            e[s, r] = 1e-6
            seen = (same & (y[:-1] == s) & (y[1:] == r)).sum()
            assert (likelihood(u, trans + e) - likelihood(u, trans - e)) / 2e-6 == pytest.approx(seen - expected[s, r], abs=1e-6)


def test_score_depends_on_the_text_alone(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_crf.train(docs, labels)
    moved = docs.withColumn("doc_id", F.col("doc_id") + 7).withColumn("source", F.lit("other"))
    a = {r["doc_id"]: r["score"] for r in quality_crf.score(docs, model).collect()}
    b = {r["doc_id"] - 7: r["score"] for r in quality_crf.score(moved, model).collect()}
    assert a == b
