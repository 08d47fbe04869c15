"""Every registered query of the engine against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pointloom.plans import driver, more  # noqa: F401

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def rows(df: pd.DataFrame) -> list[str]:
    names = sorted(df.columns)
    return sorted(repr(tuple(None if pd.isna(v) else v for v in t)) for t in df[names].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(driver.ORACLES))
def test_oracle(spark, duck, name):
    ours, theirs = driver.QUERIES[name](spark, str(DATA)).toPandas(), duck.sql(driver.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(driver.QUERIES) - set(driver.ORACLES)))
def test_runs(spark, name):
    assert driver.QUERIES[name](spark, str(DATA)).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).agg(F.count("*")).first()[0] > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_whole_tables(spark, tmp_path):
    """Raster queries against brute force, on part of a table and labels beyond two letters."""
    li = pd.read_parquet(DATA / "lineitem.parquet").head(400)
    li.to_parquet(tmp_path / "lineitem.parquet", index=False)
    pd.DataFrame({"vec_id": [0, 25, 26, 701, 702, 1999]}).to_parquet(tmp_path / "embeddings.parquet", index=False)
    got = {n: [tuple(r) for r in driver.QUERIES[n](spark, str(tmp_path)).collect()] for n in ("box_range_votes", "nearest_snap", "box_tighten", "box_normalize", "candidate_labels", "disc_dilate", "union_boxes", "body_top_rows", "view_components")}
    k = [tuple(int(v) for v in t[:4]) + (float(t[4]), t[5]) for t in li[["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag"]].itertuples(index=False, name=None)]
    spots = {}
    for o, p, s, *_ in k:
        spots.setdefault(s % 20, set()).add((p % 64, o % 64))

    votes = {}
    for v, o, role, x, y in {(s % 20, o, "reject" if f == "A" else "target", p % 40, o % 40) for o, p, s, _, _, f in k}:
        for px, py in spots[v]:
            if x <= px <= x + 12 and y <= py <= y + 9:
                votes.setdefault((v, role), {}).setdefault((px, py), set()).add((o, x, y))
    assert sorted(got["box_range_votes"]) == sorted((v, r, len(h), sum(map(len, h.values()))) for (v, r), h in votes.items())

    best = {}
    for o, p, s, n, *_ in k:
        for px, py in spots[s % 20]:
            d2 = (px - p % 64) ** 2 + (py - s % 64) ** 2
            if d2 <= 36:
                best[s % 20, o * 10 + n] = min(best.get((s % 20, o * 10 + n), (99,)), (d2, py, px))
    assert sorted(got["nearest_snap"]) == sorted((v, o, px, py, d2) for (v, o), (d2, py, px) in best.items())

    tight = []
    for v, o, x, y in {(s % 20, o * 10 + n, p % 50, s % 50) for o, p, s, n, *_ in k}:
        inside = [(a, b) for a, b in spots[v] if x <= a <= x + 8 and y <= b <= y + 8]
        near = [(a, b) for a, b in spots[v] if abs(a - x - 4) <= 12 and abs(b - y - 4) <= 12]
        use = inside or near or [(x, y), (x + 8, y + 8)]
        tight.append((v, o, min(a for a, _ in use), min(b for _, b in use), max(a for a, _ in use), max(b for _, b in use)))
    assert sorted(got["box_tighten"]) == sorted(tight)

    boxes = []
    for o, p, s, n, q, _ in k:
        a, b, c, e = (min(max(round(z), 0), top) for z, top in ((p % 100 + 0.5, 63), (s % 80, 47), (o % 90, 63), (q + 30.5, 47)))
        if a != c and b != e:
            boxes.append((o, n, min(a, c), min(b, e), max(a, c), max(b, e)))
    assert sorted(got["box_normalize"]) == sorted(boxes) and len({n for _, n, *_ in boxes}) > 1
    assert sorted(r[0] for r in got["candidate_labels"]) == [0, 25, 26, 701, 702, 1999]
    assert [r[1:] for r in sorted(got["candidate_labels"])][:4] == [("A", "A"), ("Z", "Z"), ("AA", "C27"), ("ZZ", "C702")]

    disc = [(a, b) for a in range(-2, 3) for b in range(-2, 3) if a * a + b * b <= 4]
    assert sorted(got["disc_dilate"]) == sorted({(v, x + a, y + b) for v, t in spots.items() for x, y in t for a, b in disc if 0 <= x + a <= 63 and 0 <= y + b <= 63})
    assert sorted(got["union_boxes"]) == sorted((v, max(min(x for x, _ in t) - 3, 0), max(min(y for _, y in t) - 3, 0), min(max(x for x, _ in t) + 3, 63), min(max(y for _, y in t) + 3, 63)) for v, t in spots.items())
    tops = []
    for v, t in spots.items():
        n = {y: sum(b == y for _, b in t) for _, y in t}
        rows_of = [y for y in n if n[y] >= max(2, round(max(n.values()) * 0.18))]
        tops += [(v, min(rows_of))] if rows_of else []
    assert sorted(got["body_top_rows"]) == sorted(tops)
    assert {r[0] for r in got["view_components"]} == set(spots)


def _linked(cells):
    left, found = set(cells), []
    while left:
        todo = [min(left, key=lambda c: (c[1], c[0]))]
        left -= set(todo)
        part = set(todo)
        while todo:
            x, y = todo.pop()
            near = {(x + a, y + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= near
            part |= near
            todo += near
        found.append(part)
    return found


def test_view_components(spark, tmp_path):
    li = pd.read_parquet(DATA / "lineitem.parquet").head(900)
    li.to_parquet(tmp_path / "lineitem.parquet", index=False)
    views = {}
    for o, p, s in li[["l_orderkey", "l_partkey", "l_suppkey"]].itertuples(index=False, name=None):
        views.setdefault(s % 20, set()).add((p % 64, o % 64))
    want = sorted((v, i, len(part), min(x for x, _ in part), min(y for _, y in part), max(x for x, _ in part), max(y for _, y in part)) for v, cells in views.items() for i, part in enumerate(_linked(cells)))
    got = sorted((r.view, r.component, r.area, r.x1, r.y1, r.x2, r.y2) for r in driver.QUERIES["view_components"](spark, str(tmp_path)).collect())
    assert got == want


def test_directed_components(spark):
    """The scan's components, by a plain walk along the nearest neighbours."""
    e = pd.read_parquet(DATA / "embeddings.parquet")
    want = []
    for obj, g in e.groupby("label"):
        p = {int(i): [float(x) for x in v[:3]] for i, v in zip(g.vec_id, g.embedding)}
        near = {a: sorted((b for b in p if b != a), key=lambda b: (sum((x - y) ** 2 for x, y in zip(p[a], p[b])), b))[:4] for a in p}
        seed = [a for a in sorted(p) if p[a][0] > 0]
        taken, found = set(), []
        for start in seed:
            if start in taken:
                continue
            taken.add(start)
            queue = [start]
            for a in queue:
                for b in near[a]:
                    if b in set(seed) - taken:
                        taken.add(b)
                        queue.append(b)
            if len(queue) >= 2:
                found.append(queue)
        found.sort(key=len, reverse=True)
        want += [(obj, i, a) for i, q in enumerate(found) for a in q]
    got = [(r.obj, r.component, r.point) for r in driver.QUERIES["directed_components"](spark, str(DATA)).collect()]
    assert sorted(got) == sorted(want)


def test_queries_stay_without_optional_libraries():
    """With a library of the optional subpackage gone, the engine's queries are all there."""
    import subprocess
    import sys

    root = Path(__file__).resolve().parent.parent
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), 'op6_media' in q, set(e.oracle_sql()) <= set(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == [str(len(driver.QUERIES)), "False", "True"], out.stderr[-500:]
