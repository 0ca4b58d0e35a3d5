"""Operators 5, 6, 7, 9 and 10 against SQL or brute force, on odd rows and on the small tables."""

import hashlib
import itertools
import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from girder.llm import bpe, chat, common, ivfpq, kdtree, licenses, wordpiece
from girder.llm.known_licenses import EQUIVALENT, FULL_TEXTS, IN_SENTENCES, KNOWN
from girder.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def by_sql(sql, columns, folder=SF):
    con = duckdb.connect()
    for f in sorted(Path(folder).iterdir()):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f if f.is_file() else f / '*.parquet'}')")
    return Counter(map(tuple, con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()))


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    out = QUERIES[name](spark, SF)
    assert Counter(map(tuple, out.collect())) == by_sql(SQL[name], out.columns)


# --- Licenses


def test_licenses(spark, odd, empty):
    mit = dict(reversed(KNOWN))["MIT"]
    texts = [
        (1, mit, "MIT"), (2, mit.upper().replace("\n\n", "\n\n\n  "), "MIT"), (3, "Copyright (c) 2020 A Person\n\n" + mit.replace("sublicense", "sub-licence"), "MIT"),
        (4, "© 1999-2004 Some Body. All rights.\nCopyright <year> <holder>\n" + mit, "MIT"), (5, mit + " And more.", None), (6, mit.replace("free of charge", "for a charge"), None),
        (7, "Released under the MIT Licence", "MIT"), (8, "", None), (9, None, None), (10, "...", None),
    ]
    docs = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    assert {k: r.license for k, r in got.items()} == {i: name for i, _, name in texts}
    assert got[9].digest is None and got[8].digest == got[10].digest
    lines = spark.createDataFrame([(1, "Some text.\nReleased under the MIT License.\n* Licensed under CC BY-NC 4.0 *\nreleased under the mit licence!\nLicensed under what?")], "doc_id long, text string")
    assert licenses.license_scan(lines).first().line_licenses == ["CC-BY-NC-4.0", "MIT"]
    assert licenses.license_scan(odd).count() == odd.count() and licenses.license_scan(empty).count() == 0
    assert not licenses.license_scan(odd).where("license is not null").count()


def plain_form(text):
    """The canonical form by a way of its own: line by line and character by character."""
    words = lambda x: "".join(c if unicodedata.category(c)[0] in "LMN" else " " for c in x).split()
    kept = []
    for line in text.replace("İ", "i").lower().replace("ς", "σ").split("\n"):
        said, marked = words(line), re.search(r"\d{4}|19yy|year|yyyy|all rights reserved", line.replace("٠", "x"))
        begins = "".join(itertools.takewhile(lambda c: unicodedata.category(c)[0] not in "LMN", line))
        notice = "©" in begins or said == ["all", "rights", "reserved"]
        if said[:1] == ["copyright"]:
            notice |= bool(marked) or len(said) > 1 and said[1] not in IN_SENTENCES
        elif line[len(begins) :].startswith("c)") and begins.endswith("("):
            notice |= bool(marked)
        if not notice:
            kept.append(line)
    out = " ".join(words("\n".join(kept).replace("&", " and ")))
    for one, other in EQUIVALENT:
        out = out.replace(one, other)
    return out


def plain_license(text):
    by = {}
    for name, known in KNOWN:
        by.setdefault(plain_form(known), set()).add(name)
    full = {digest: name for name, _, digest in FULL_TEXTS}
    form = plain_form(text)
    return min(by.get(form, ()), default=full.get(hashlib.sha256(form.encode()).hexdigest()))


MIT = dict(reversed(KNOWN))["MIT"]


def planted():
    """Whole license texts in many dresses, and texts that only nearly are."""
    rng = random.Random(12)
    out = [("这不是自由软件，不要复制\n" + MIT, None), ("Это не свободная программа.\n" + MIT, None), (MIT + "\nЛицензия", None), (MIT.replace("free of charge", "for a charge"), None), ("Not the " + MIT, None), ("", None), ("Copyright 2020 Me", None)]
    heads = ["Copyright John Smith. All rights reserved.", "Copyright (c) 2020 A. Person", "© Jemand", "# Copyright by Some One", "(C) 1999, Somebody\nAll rights reserved.", "COPYRIGHT: The Authors, 2001-2004", "Copyright <year> <holder>", "Copyright Ünal Çelik"]
    for name, text in KNOWN:
        if len(text) > 400:
            for head in heads:
                body = text
                if rng.random() < 0.5:  # lines broken elsewhere, also before "copyright"
                    body = re.sub(r" (copyright) ", r"\n\1 ", body) if rng.random() < 0.5 else re.sub(r"\s+", lambda m: "\n" if rng.random() < 0.2 else " ", body)
                if rng.random() < 0.5:
                    body = rng.choice([str.upper, str.lower])(body)
                if rng.random() < 0.3:
                    body = re.sub(r"[.,;:()\"']", lambda m: rng.choice([m[0], " ", "—"]) if m[0] in ".,;:\"'" else m[0], body)
                out.append((f"{head}\n\n{body}".replace("license", rng.choice(["license", "licence"])), name))
    return out


def test_planted_whole_texts(spark):
    """Whole texts are found and additions in any script aren't forgiven; Spark, DuckDB and plain Python agree."""
    texts = planted()
    docs = spark.createDataFrame([(i, t, 1, 2) for i, (t, _) in enumerate(texts)], "doc_id long, text string, license int, line_licenses int")
    got = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    for i, (text, name) in enumerate(texts):
        assert got[i].license == plain_license(text) == name, text[:200]
        assert got[i].digest == hashlib.sha256(plain_form(text).encode()).hexdigest()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, (t, _) in enumerate(texts)])
    assert {r[0]: r[1:3] for r in con.execute(licenses.sql()).fetchall()} == {i: (r.digest, r.license) for i, r in got.items()}


def test_query_against_plain_forms(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = {r.doc_id: r for r in QUERIES["op5_licenses"](spark, SF).collect()}
    assert len(rows) == len(docs)
    for d in docs:
        lines = sorted({plain_license(x) for x in d.text.split("\n")} - {None})
        assert (rows[d.doc_id].digest, rows[d.doc_id].license, rows[d.doc_id].line_licenses) == (hashlib.sha256(plain_form(d.text).encode()).hexdigest(), plain_license(d.text), ",".join(lines))


@pytest.mark.skipif(not Path("/usr/share/common-licenses").is_dir(), reason="full license texts aren't installed")
def test_full_license_texts(spark):
    names = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}
    texts = {n: (Path("/usr/share/common-licenses") / n).read_text() for n in names}
    docs = spark.createDataFrame([*texts.items(), ("more", texts["GPL-3"] + " And more.")], "doc_id string, text string")
    assert {r.doc_id: r.license for r in licenses.license_scan(docs).collect()} == names | {"more": None}


# --- Preference formatting


def plain_pair(chosen, rejected):
    clean = lambda side: [tuple((x if x is not None else other).replace("<|", "< |") for x, other in zip(t, ("unknown", ""), strict=True)) for t in side or []]
    c, r = clean(chosen), clean(rejected)
    n = 0
    while n < min(len(c), len(r)) and c[n] == r[n]:
        n += 1
    turn = lambda t: f"<|{t[0]}|>\n{t[1]}<|end|>\n"
    prompt = "".join(map(turn, c[:n]))

    def completion(side):
        text, spans = prompt, []
        for t in side[n:]:
            if t[0] == "assistant":
                spans.append((len(text) + len(f"<|{t[0]}|>\n"), len(text) + len(turn(t)) - 1))
            text += turn(t)
        return text[len(prompt) :], spans

    return n, prompt, *completion(c), *completion(r), c == r


def test_preference(spark):
    rng = random.Random(1)
    pairs = []
    for i in range(200):
        conv = lambda: [(rng.choice(["user", "assistant", "system", None]), rng.choice(["a", "é😀", "", None, "x<|end|>\n<|user|>"])) for _ in range(rng.randrange(5))]
        same = conv()
        pairs.append((i, rng.choice([same + conv(), same, None]), rng.choice([same + conv(), same])))
    kind = "array<struct<role:string,text:string>>"
    df = spark.createDataFrame(pairs, f"conv_id long, chosen {kind}, rejected {kind}").withColumns({"prompt": F.lit(1), "tied": F.lit(2)})
    for r in chat.preference_format(df).collect():
        n, prompt, c, cs, j, js, tied = plain_pair(*pairs[r.conv_id][1:])
        assert (r.prompt_turns, r.prompt, r.chosen, r.rejected, r.tied) == (n, prompt, c, j, tied)
        assert list(map(tuple, r.chosen_spans)) == cs and list(map(tuple, r.rejected_spans)) == js
        for start, end in cs:
            assert (prompt + c)[start:end].endswith("<|end|>")
    assert chat.preference_format(df.limit(0)).count() == 0


def test_conversations(spark):
    rows = [(1, 2, "user", "b", 0), (1, 1, "user", "a", 0), (1, 2, "assistant", "c", 0), (1, 2, "assistant", "c", 0), (2, None, None, None, 0), (None, 0, "user", "z", 0)]
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int")).collect()}
    assert got == {1: [("user", "a"), ("assistant", "c"), ("assistant", "c"), ("user", "b")], 2: [(None, None)], None: [("user", "z")]}


def test_turns_without_an_id_are_not_gathered(spark):
    """Two thirds of all rows have none; each is a conversation, and no group of them is made."""
    df = spark.createDataFrame([(None if i % 3 else i, i, "assistant", f"t{i}") for i in range(300)], "conv_id long, turn long, role string, text string")
    rows = chat.conversations(df).collect()
    assert Counter(len(r.turns) for r in rows) == {1: 300} and sorted(r.turns[0].text for r in rows if r.conv_id is None) == sorted(f"t{i}" for i in range(300) if i % 3)


def test_other_reply_over_gaps(spark):
    ids = [*range(0, 40, 7), 63, 64, 128, 130, 191, 1000]
    kind = "array<struct<role:string,text:string>>"
    convs = [(i, [("user", f"q{i}"), ("assistant", f"a{i}"), ("user", "thanks")]) for i in ids] + [(65, [("user", "no reply")]), (None, [("user", "q"), ("assistant", "a")])]
    got = {r.conv_id: [tuple(t) for t in r.rejected] for r in chat.with_other_reply(spark.createDataFrame(convs, f"conv_id long, turns {kind}")).collect()}
    for i in ids:
        near = [j for j in ids if j // 64 == i // 64]
        other = near[(near.index(i) + 1) % len(near)]
        assert got[i] == [("user", f"q{i}")] + ([("assistant", f"a{other}")] if other != i else [])
    assert got[65] == [("user", "no reply")] and got[None] == [("user", "q")]


def test_preference_sql_on_odd_rows(spark, tmp_path):
    rows = [(1, 1, "user", "a"), (1, 2, "assistant", "b"), (2, 1, "user", "a"), (2, 2, "assistant", None), (2, 2, "assistant", None), (9, 0, None, "x<|end|>"), (None, 1, "assistant", "n"), (None, 1, "assistant", "n"), (None, None, None, None), (70, 1, "assistant", "alone"), (1, 1, "user", "a")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    out = QUERIES["op6_preference"](spark, str(tmp_path))
    assert Counter(map(tuple, out.collect())) == by_sql(SQL["op6_preference"], out.columns, tmp_path)


# --- k-d tree


def check_shards(rows, docs, n):
    sizes = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((d.doc_id, sizes(d.text), zlib.crc32((d.text or "").encode())) for d in docs)
    held, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        held[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    for v in slots.values():
        assert sorted(v) == list(range(len(v)))
    assert set(held) <= set(range(n))
    return held


@pytest.mark.parametrize("sf,n", [("sf0.001", 8), ("sf0.01", 8), ("sf0.01", 5), ("sf0.001", 1)])
def test_shards(spark, sf, n):
    df = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    docs = df.collect()
    rows = kdtree.shards(df, n_shards=n).collect()
    held = check_shards(rows, docs, n)
    total, largest = sum(held.values()), max(r["size"] for r in rows)
    assert len(held) == n and all(abs(v - total / n) <= 3 * largest for v in held.values())
    assert sorted(rows) == sorted(kdtree.shards(df.repartition(3), n_shards=n).collect())


def test_median_is_the_median(spark):
    """Against a sort of all places: half of the bytes lie on either side, to within one document."""
    rng = random.Random(4)
    rows = [(1, rng.choice([1, 5, 2000]), rng.choice([7 << 31, rng.getrandbits(62)]) | rng.getrandbits(31)) for _ in range(3000)] + [(2, 1, 5)] * 3
    df = spark.createDataFrame(rows, "node long, size long, p long")
    nodes = df.groupBy("node").agg(F.min("p").alias("low"), F.max("p").alias("high"), F.sum("size").alias("bytes")).withColumn("share", F.when(F.col("node") == 1, 0.5).otherwise(0.25))
    for most in (2, 10**6):
        cut = {r.node: r.cut for r in kdtree._medians(df, nodes, most).collect()}
        below, whole = sum(s for n, s, p in rows if n == 1 and p <= cut[1]), sum(s for n, s, _ in rows if n == 1)
        assert abs(below - whole / 2) <= 1000 + kdtree.TOLERANCE * whole


def plain_tree(rows, leaves, dims):
    """Shard of each row (size, places): sorts along the widest dimension and cuts at the bytes."""
    scale = [max(1, max(r[1][d] >> 31 for r in rows) - min(r[1][d] >> 31 for r in rows)) for d in range(dims)]
    out, widest = {}, Counter()

    def split(held, n, first):
        if n == 1 or not held:
            out.update(dict.fromkeys(held, first))
            return
        width = [(max(rows[i][1][d] >> 31 for i in held) - min(rows[i][1][d] >> 31 for i in held)) / scale[d] for d in range(dims)]
        d = max(range(dims), key=lambda x: (width[x], -x))
        widest[d] += 1
        left = (n + 1) // 2
        aim = left / n * sum(rows[i][0] for i in held)
        by = defaultdict(list)
        for i in held:
            by[rows[i][1][d]].append(i)
        before, low, high = 0, [], []
        for place in sorted(by):
            here = sum(rows[i][0] for i in by[place])
            near = before + here <= aim or before < aim and abs(before + here - aim) <= abs(before - aim)
            (low if near else high).extend(by[place])
            before += here
        split(low, left, first)
        split(high, n - left, first + left)

    split(list(range(len(rows))), leaves, 0)
    return out, widest


@pytest.mark.parametrize("sf,leaves", [("sf0.001", 8), ("sf0.01", 8), ("sf0.001", 5), ("sf0.001", 1)])
def test_query_is_the_tree(spark, monkeypatch, sf, leaves):
    """Shards by sorting, over whole tables; the widest dimension is the one that is cut."""
    monkeypatch.setattr(kdtree, "TOLERANCE", 0.0)
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    hashes = {r.doc_id: r.tie for r in docs.select("doc_id", F.shiftrightunsigned(F.xxhash64(F.lit(kdtree.SEED), "doc_id", "text"), 33).alias("tie")).collect()}
    found = docs.collect()
    number = {c: {v: i for i, v in enumerate(sorted({r[c] for r in found}, key=lambda v: v.encode()))} for c in ("source", "lang")}
    rows = [(len(r.text.encode()) + 1, tuple(v << 31 | hashes[r.doc_id] for v in (len(r.text.encode()) + 1, r.n_chars, number["source"][r.source], number["lang"][r.lang]))) for r in found]
    want, widest = plain_tree(rows, leaves, 4)
    got = QUERIES["op7_kdtree"](spark, f"/root/testdata/{sf}") if leaves == 8 else kdtree.shards(docs, n_shards=leaves)
    assert {r.doc_id: r.shard for r in got.collect()} == {found[i].doc_id: s for i, s in want.items()}
    assert leaves < 8 or len(widest) > 1


def test_names_with_a_common_beginning_are_told_apart(spark):
    df = spark.createDataFrame([(i, "x" * 99, "en", f"host_{'ab'[i % 2]}", 99) for i in range(400)], "doc_id long, text string, lang string, source string, n_chars long")
    held = defaultdict(set)
    for r in kdtree.shards(df, n_shards=2).collect():
        held[r.shard].add(r.doc_id % 2)
    assert sorted(map(sorted, held.values())) == [[0], [1]]


def test_many_leaves(spark, monkeypatch):
    """Limits of nodes are joined: as many shards as documents, with and without broadcasts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    want = sorted(kdtree.shards(docs, n_shards=12).collect())
    monkeypatch.setattr(common, "MOST_BROADCAST", 0)
    assert sorted(kdtree.shards(docs, n_shards=12).collect()) == want
    check_shards(want, docs.collect(), 12)


def test_shards_odd(spark, odd, empty):
    docs = odd.collect()
    check_shards(kdtree.shards(odd, n_shards=8).collect(), docs, 8)
    assert kdtree.shards(empty, n_shards=8).count() == 0
    some = spark.read.parquet(f"{SF}/documents.parquet")
    assert len({r.shard for r in kdtree.shards(some, target_bytes=50_000).collect()}) == math.ceil(sum(len(r.text.encode()) + 1 for r in some.collect()) / 50_000)
    same = spark.createDataFrame([(i, "the same", "en", "a", 8) for i in range(800)], "doc_id long, text string, lang string, source string, n_chars long")
    assert all(90 <= n <= 110 for n in Counter(r.shard for r in kdtree.shards(same, n_shards=8).collect()).values())


def test_slots_over_several_ranges(spark):
    df = spark.createDataFrame([(i, 1, 0, (i * 7919) % (1 << 31), i % 3) for i in range(1000)], "doc_id long, size long, text_crc32 long, tie long, shard int")
    slots = defaultdict(list)
    for r in kdtree.numbered(df, 17).collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


# --- Nearest neighbours


def plain_nearest(rows, asked, k=5):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok[i] = np.array(v, np.float64)
    ids = sorted(ok)
    out = {}
    for q in filter(asked, ids):
        near = sorted((-float(ok[q] @ ok[i] / (np.sqrt(ok[q] @ ok[q]) * np.sqrt(ok[i] @ ok[i]))), i) for i in ids if i != q)
        out[q] = near[:k]
    return out


def recall(got, want):
    hits = sum(len({r.vec_id for r in got if r.query_id == q} & {i for _, i in near}) for q, near in want.items())
    return hits / max(1, sum(map(len, want.values())))


def test_nearest_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = QUERIES["op9_ivfpq"](spark, SF).collect()
    want = plain_nearest(rows, lambda i: i % 50 == 0)
    assert recall(got, want) >= 0.9
    exact = dict(rows)
    for r in got:
        a, b = np.array(exact[r.query_id], np.float64), np.array(exact[r.vec_id], np.float64)
        assert r.score == pytest.approx(float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)), abs=1e-12)
    for q in want:
        mine = sorted((r["rank"], -r.score, r.vec_id) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and [m[1:] for m in mine] == sorted(m[1:] for m in mine)


def test_nearest_odd(spark):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(40)]
    rows += [(i, [1.0, 2.0, 3.0]) for i in range(100, 130)] + [(i, [2.0, 4.0, 6.0]) for i in range(130, 134)]
    rows += [(200, None), (201, [0.0, 0.0, 0.0]), (202, [1.0, None, 2.0]), (203, [float("nan"), 1.0, 1.0]), (204, [float("inf"), 1.0, 1.0]), (205, []), (206, [1.0]), (None, [1.0, 1.0, 1.0])]
    rows += [(300, [1.0, 0.0, 0.0]), (300, [1.0, 0.0, 0.0]), (301, [1e-200, 0.0, 1e-200]), (302, [1e200, 1e200, 0.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, query int, score int")
    got = ivfpq.nearest(df, F.col("vec_id") % 2 == 0).collect()
    want = plain_nearest([r for r in rows if r[0] not in (301, 302, 206)], lambda i: i % 2 == 0)
    assert {r.query_id for r in got} == set(want) | {302}
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 110), key=lambda r: r["rank"])] == [100, 101, 102, 103, 104]
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 100), key=lambda r: r["rank"])] == [101, 102, 103, 104, 105]
    few = spark.createDataFrame([(0, [1.0, 1.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in ivfpq.nearest(few, F.col("vec_id") == 0).collect()] == [(0, 1, 1)]
    assert ivfpq.nearest(few.limit(0)).count() == 0 and ivfpq.nearest(few, F.lit(False)).count() == 0 and ivfpq.nearest(few.limit(1)).count() == 0


def test_recall_and_blocks(spark, monkeypatch):
    """Clustered vectors, with lists over several blocks and queries in several chunks."""
    monkeypatch.setattr(ivfpq, "BLOCK_ROWS", 100)
    monkeypatch.setattr(ivfpq, "QUERY_ROWS", 40)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 16))
    x = centres[np.minimum(rng.integers(40, size=3000), 19)] + 0.4 * rng.normal(size=(3000, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = ivfpq.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    assert recall(got, plain_nearest(rows, lambda i: i % 20 == 0)) >= 0.9


def test_entries_are_copied_only_where_queries_crowd(spark):
    """Ten times the table and its queries over ten times the blocks make ten times the rows; a crowded block alone is copied."""
    for n in (1, 10):
        entries = spark.range(1000 * n).select(F.col("id").alias("entry"), (F.col("id") % (10 * n)).cast("int").alias("block"))
        visits = spark.range(100 * n).select(F.col("id").alias("query"), (F.col("id") % (10 * n)).cast("int").alias("block"))
        crowd = spark.range(5000, 5100).select(F.col("id").alias("query"), F.lit(0).alias("block"))
        every, asking = ivfpq._chunked(entries, visits.union(crowd), 20)
        assert asking.count() == 100 * n + 100
        assert every.count() == 100 * (10 * n - 1) + 100 * 6


def test_recall_in_a_group_of_near_copies(spark, monkeypatch):
    """A third of the vectors, and 300 others, differ by less than codes can tell."""
    monkeypatch.setattr(ivfpq, "BLOCK_ROWS", 400)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 64))
    x[:667] = x[0] + 0.001 * rng.normal(size=(667, 64))
    x[1000:1300] = x[1000] + 0.02 * rng.normal(size=(300, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    crowded = lambda i: i % 20 == 0 and (i < 667 or 1000 <= i < 1300)
    got = ivfpq.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), (F.col("vec_id") % 20 == 0) & ((F.col("vec_id") < 667) | F.col("vec_id").between(1000, 1299))).collect()
    assert recall(got, plain_nearest(rows, crowded)) >= 0.99


# --- Word pieces


def plain_pieces(word, first, later):
    """Greedy longest match, piece by piece."""
    n, at = 0, 0
    while at < len(word):
        pool = later if n else first
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pool), None)
        if end is None:
            return 1
        n, at = n + 1, end
    return n


def test_automaton():
    rng = random.Random(6)
    for _ in range(150):
        make = lambda n: {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5))) for _ in range(n)}
        first, later = make(rng.randrange(8)), make(rng.randrange(8))
        automaton = wordpiece.Automaton(sorted(first), sorted(later))
        for _ in range(100):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randrange(12)))
            assert automaton.count(word) == plain_pieces(word, first, later), (first, later, word)


def test_any_word_can_be_cut(spark):
    """Runs of scripts without spaces are counted by pieces; a longer run has more."""
    data, _ = bpe.vocabulary_of(spark, "byte_bpe_multi_50k.tiktoken")
    first, later = map(set, wordpiece.pieces_of(data))
    assert {bytes([b]) for b in range(256) if bytes([b]).split()} <= first & later
    automaton = wordpiece.Automaton(*wordpiece.pieces_of(data))
    for run in ("日本語の文章です", "中文没有空格", "ภาษาไทย"):
        words = [(run * n).encode() for n in (1, 2, 4)]
        counts = [automaton.count(w) for w in words]
        assert counts == [plain_pieces(w, first, later) for w in words] and 1 < counts[0] < counts[1] < counts[2]


def test_token_counts(spark, odd, empty):
    data, _ = bpe.vocabulary_of(spark, "byte_bpe_multi_50k.tiktoken")
    first, later = map(set, wordpiece.pieces_of(data))
    longest = max(map(len, first | later))

    def pieces(word):
        """Greedy longest match, no further than the longest piece."""
        n, at = 0, 0
        while at < len(word):
            pool = later if n else first
            end = next((e for e in range(min(len(word), at + longest), at, -1) if word[at:e] in pool), None)
            if end is None:
                return 1
            n, at = n + 1, end
        return n

    count = lambda t: sum(map(pieces, (t or "").encode().split()))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in QUERIES["op10_wordpiece"](spark, SF).collect()}
    assert got == {i: (len(t.encode().split()), count(t)) for i, t in docs.items()}
    # The odd rows have a word of 5,000 letters, and this one of 200,000 in several scripts.
    long = odd.union(odd.limit(1).withColumn("text", F.lit("naïveté日本語ของthe" * 10_000)))
    rows = Counter((r.doc_id, r.n_words, r.n_tokens) for r in wordpiece.token_counts(long, data).collect())
    assert rows == Counter((r.doc_id, len((r.text or "").encode().split()), count(r.text)) for r in long.collect())
    assert wordpiece.token_counts(empty, data).count() == 0
