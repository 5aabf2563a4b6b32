"""Contract documents against a plain reader."""

import random
import re

from pyspark.sql import functions as F

from attestra.sources import contracts as C

TABLES = {"One": ["a", "b"], "Two": ["x"]}


def plain(text):
    """Sections as a reader goes through the lines; duplicates and tables as the contract has them."""
    found, name, fence, out = {}, None, None, set()
    for n, line in enumerate((text or "").splitlines(), 1):
        mark = re.match(r"^\s*(`{3,}|~{3,})", line)
        if mark:
            fence = None if fence == mark[1][0] else (fence or mark[1][0])
        head = None if fence else re.match(r"^##\s+(.+?)\s*#*\s*$", line)
        if head:
            name = head[1]
            found.setdefault(name, []).append((n, []))
        elif name is not None:
            found[name][-1][1].append((n, line))
    for section, header in TABLES.items():
        parts = found.get(section, [])
        if len(parts) != 1:
            out.add((section, None, None, None, "duplicate_section" if parts else "missing_section", parts[1][0] if parts else None))
            continue
        start, body = parts[0]
        rows = [(n, [c.strip().replace(r"\|", "|") for c in re.split(r"(?<!\\)\|", line.strip().strip("|"))]) for n, line in body if line.strip().startswith("|")]
        rows = [(n, r) for n, r in rows if not all(re.fullmatch(r":?-+:?", c) for c in r)]
        odd = [n for n, r in rows if len(r) != len(header)]
        if odd or not rows or rows[0][1] != header:
            out.add((section, None, None, None, "columns" if odd else "header", odd[0] if odd else start))
            continue
        out |= {(section, k, c, v, None, n) for k, (n, r) in enumerate(rows) if k for c, v in zip(header, r, strict=True)}
    return out


def test_documents(spark):
    good = "# t\n## One\n| a | b |\n|---|:-:|\n| 1 | x\\|y |\n|  |  |\n```\n## One\n```\n## Two ##\r\n| x |\r\n| é |\r\n"
    r = random.Random(8)
    pieces = ["## One", "## Two", "## Else", "| a | b |", "| x |", "|--|:-|", "| 1 | 2 |", " | p\\|q | |", "| 1 | 2 | 3 |", "```", "~~~", "````py", "text", "", "# One", "### Two", "##Two", "| |", "|"]
    texts = [good, "", None, "## One", good.replace("## Two ##", "## One"), good.replace("| 1 |", "| 1 | 1 |"), good.replace("| a | b |", "| b | a |"), good + "## Two\n"]
    texts += [r.choice(["\n", "\r\n", "\x0b", " "]).join(r.choice(pieces) for _ in range(r.randrange(1, 16))) for _ in range(400)]
    texts += ["\n".join(["## One", "| a | b |", *[r.choice(pieces[5:]) for _ in range(r.randrange(5))], "## Two", "| x |", *[r.choice(pieces[9:]) for _ in range(r.randrange(5))]]) for _ in range(200)]
    got: dict = {}
    for x in C.contract_tables(spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3), "id", F.col("text"), TABLES).collect():
        got.setdefault(x.id, set()).add((x.section, x.row, x.column, x.cell, x.error, x.line))
    assert got == {i: rows for i, t in enumerate(texts) if (rows := plain(t))}
    assert {e[4] for v in got.values() for e in v} == {None, "duplicate_section", "missing_section", "columns", "header"}
    assert ("One", 1, "b", "x|y", None, 5) in got[0] and ("Two", 1, "x", "é", None, 12) in got[0]
