"""Queries that SQL can't say against plain versions, over whole tables; knowledge in versions."""

import difflib
import re

from pyspark.sql import functions as F

from girder.functions.restoring import plain
from girder.operators import relational, retrieval
from girder.queries import QUERIES
from girder.sources import sinks

SF = "/root/testdata/sf0.001"


def plain_chunks(markdown, most):
    """Line by line: a chunk takes a line as long as it fits, and one at least."""
    sections, name = [], ""
    for line in markdown.splitlines():
        if line.startswith("### ") or not sections:
            name = line[4:].strip() if line.startswith("### ") else ""
            sections.append((name, []))
        sections[-1][1].append(line)
    out = []
    for name, lines in sections:
        if len("\n".join(lines).strip()) <= most:
            out.append((name, "\n".join(lines).strip()))
            continue
        part = []
        for i, line in enumerate(lines):
            if part and sum(len(x) + 1 for x in part) + len(line) > most:
                out.append((name, "\n".join(part).strip()))
                top = i
                while top and line.startswith("|") and lines[top - 1].startswith("|"):
                    top -= 1
                head = lines[top : top + 2] if line.startswith("|") and i > top + 1 and re.match(r"\|\s*:?-", lines[top + 1]) else []
                part = ([f"### {name} (tiếp)"] if name else []) + head
            part.append(line)
        out.append((name, "\n".join(part).strip()))
    return [c for c in out if c[1]]


def test_chunks_against_plain_packing(spark):
    table = "| STT | kg |\n| --- | --- |\n" + "\n".join(f"| {i} | {'x' * (i % 7)} |" for i in range(40))
    odd = ["", "### a\n" + "\n".join("y" * (i % 30) for i in range(80)), f"đầu\n{table}\n\n### b\n{table}\ncuối", "z" * 500, "|a|\n|-|\n|b|", f"### c\n| không có kẻ |\n{table}"]
    for most in (40, 100, 300):
        assert [retrieval.pack(m, most) for m in odd] == [plain_chunks(m, most) for m in odd]
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.regexp_replace("text", r"(?m)^(\S+)\.$", "### $1").alias("m")).collect()
    want = {(r.doc_id, k): chunk for r in texts for k, chunk in enumerate(plain_chunks(r.m, 1000), 1)}
    rows = QUERIES["chunk_sections"](spark, SF).collect()
    got = {(r.source, int(r.id.rsplit("/", 1)[1])): (r.section, r.text.split("]\n", 1)[1]) for r in rows}
    assert got == want and len(rows) == len(want)


def plain_notes(bullets):
    """Bullets of one section, each compared with all others."""
    key = lambda t: " ".join(plain(t).lower().split())
    marks = lambda t: sum(ord(c) > 127 for c in t)
    fuller = lambda a, b: b if (marks(b) > 1.1 * marks(a) and len(b) > 5) or len(b) > 1.2 * len(a) else a
    used, out, seen = set(), [], set()
    for i, text in enumerate(bullets):
        if i in used:
            continue
        best = text
        for j in range(i + 1, len(bullets)):
            if j not in used and key(text) and key(bullets[j]) and difflib.SequenceMatcher(None, key(text), key(bullets[j])).ratio() >= 0.82:
                best = fuller(best, bullets[j])
                used.add(j)
        if key(best)[:60] not in seen:
            seen.add(key(best)[:60])
            out.append(best)
    return out


def plain_garbled(t):
    alpha = [c for c in t if c.isalpha()]
    solid = " " not in t and t.replace("-", "").replace("_", "").isupper()
    vowels = sum(c in "aeiouy" for c in plain(t).lower()) / max(1, len(alpha))
    return len(t) >= 8 and bool(alpha) and (len(alpha) >= 12 and (vowels < 0.08 or solid and vowels < 0.2) or solid and len(t) >= 16 and t.isascii())


def said_again(words):
    """A run of 3 to 6 words at the start that comes again, or one of 4 or 3 anywhere."""
    folded = [plain(w).lower() for w in words]
    runs = lambda n: (folded[i : i + n] for i in range(len(folded) - n + 1))
    again = any(folded[:n] == run for n in range(3, 7) for i, run in enumerate(runs(n)) if i >= n)
    return len(words) >= 5 and (again or any(a == b for n in (3, 4) for i, a in enumerate(runs(n)) for j, b in enumerate(runs(n)) if j >= i + n))


def test_notes_against_all_pairs(spark):
    texts = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    want = {}
    for r in texts:
        bullets = [b.strip() for b in re.split(r"[.\n]\s*", r.text)]
        assert not any(said_again(b.split()) for b in bullets)
        clean = plain_notes([b for b in bullets if b and not plain_garbled(b)])
        # A bullet's mark needs a space behind it and the line goes if nothing follows.
        want[r.item_id] = "\n".join(["## Ghi chú", *("- " + b for b in clean)])
    got = QUERIES["notes_cleaned"](spark, SF).collect()
    assert {r.item_id: (r.lines_after, r.chars_after) for r in got} == {k: (v.count("\n") + 1, len(v)) for k, v in want.items()}


def test_knowledge_in_versions(spark, tmp_path):
    path = f"file://{tmp_path}/base"
    assert sinks.knowledge(spark, path, "terms") is None
    one = spark.createDataFrame([("a", 1)], "term string, cnt int")
    sinks.save_knowledge(path, terms=one)
    sinks.save_knowledge(path, terms=sinks.knowledge(spark, path, "terms").unionByName(one))
    assert sinks.knowledge(spark, path, "terms").count() == 2
    # A version that was not finished isn't read, and isn't written over.
    (tmp_path / "base/terms/v00000003").mkdir()
    assert sinks.knowledge(spark, path, "terms").count() == 2
    sinks.save_knowledge(path, terms=one)
    assert sinks.knowledge(spark, path, "terms").count() == 1 and (tmp_path / "base/terms/v00000004").is_dir()


def test_pages_of_documents(spark):
    objects = spark.createDataFrame([(1, 1, "image", 50.0, 100.0), (2, 1, "image", 10.0, 100.0), (2, 1, "path", 1.0, 100.0)], "doc_id int, page int, kind string, area double, page_area double")
    assert sorted(map(tuple, relational.object_stats(objects, ["image", "path"]).collect())) == [(1, 1, 1, 0, 0.5), (2, 1, 1, 1, 0.1)]
    pages = spark.createDataFrame([(i,) for i in range(1, 10)], "page int")
    chosen = lambda value: sorted(r.page for r in relational.select_pages(pages, value).collect())
    assert chosen("") == list(range(1, 10)) and chosen(" 2-4, 3,9") == [2, 3, 4, 9]
