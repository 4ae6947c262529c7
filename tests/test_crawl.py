"""The crawl's order and limit against a queue."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from weftline.operators import site


def plain(edges, start, sitemap, fetched, limit):
    """A queue, one page at a time: (node, depth) in order, and whether something is left."""
    links, final, ok = {}, {}, {}
    for s, d, p in edges:
        if s != d:
            links.setdefault(s, {})
            links[s][d] = min(links[s].get(d, p), p)
    for n, f, o in fetched or []:
        final[n], ok[n] = f, o
    queue, queued, seen, out = deque((n, 0) for n in sorted(start)), set(start), set(), []

    def run():
        while queue and (limit is None or len(out) < limit):
            node, depth = queue.popleft()
            if node in seen:
                continue
            seen.add(node)
            if not (ok.get(node, False) if fetched is not None else True):
                continue
            out.append((node, depth))
            queued.add(final.get(node, node))
            seen.add(final.get(node, node))
            for d, _ in sorted(links.get(node, {}).items(), key=lambda x: (x[1], x[0])):
                if d not in queued:
                    queued.add(d)
                    queue.append((d, depth + 1))

    run()
    for n in sorted(set(sitemap)):
        if n not in queued and n not in seen:
            queued.add(n)
            queue.append((n, -1))
    run()
    return out, bool([n for n, _ in queue if n not in seen]) or bool(set(sitemap) - seen - queued)


def told(spark, edges, start, sitemap, fetched, limit):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    asked = frame(fetched, "node long, final long, ok boolean") if fetched is not None else None
    crawled = site.crawl_order(frame(edges, "src long, dst long, pos int"), frame([(n,) for n in start], "node long"), frame([(n,) for n in sitemap], "node long"), asked, limit)
    rows = crawled.pages.orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    return [(r.node, r.depth) for r in rows], crawled.limit_reached


@pytest.mark.parametrize("seed, limit, failing", [(1, None, False), (2, 25, False), (3, None, True), (4, 40, True), (5, 1, True)])
def test_order_is_a_queues(spark, seed, limit, failing):
    rng = random.Random(seed)
    n = 90
    edges = [(rng.randrange(n), rng.randrange(n), rng.randrange(6)) for _ in range(160)]
    edges += [(i, i + 1, 0) for i in range(0, 20)] + edges[:10]
    # What an address leads to leads no further.
    fetched = [(i, i + 1 if i % 11 == 5 else i, i % 11 == 6 or rng.random() < 0.85) for i in range(n)] if failing else None
    sitemap = rng.sample(range(n), 40)
    got, want = told(spark, edges, [0], sitemap, fetched, limit), plain(edges, [0], sitemap, fetched, limit)
    assert got == want


def test_limit_met_exactly(spark):
    edges = [(0, 1, 0), (1, 2, 0)]
    assert told(spark, edges, [0], [], None, 3) == ([(0, 0), (1, 1), (2, 2)], False)
    assert told(spark, edges, [0], [], None, 2) == ([(0, 0), (1, 1)], True)
    assert told(spark, edges, [0], [7], None, 3) == ([(0, 0), (1, 1), (2, 2)], True)
    assert told(spark, [], [], [5, 4], None, None) == ([(4, -1), (5, -1)], False)
    assert told(spark, [], [], [], None, 9) == ([], False)
    assert told(spark, edges, [0], [], [(0, 0, False)], 5) == ([], False)


def test_rounds_end_at_the_limit(spark, monkeypatch):
    """A path of many pages: as many rounds as the limit takes, not as the path is long."""
    rounds = []
    place = site._in_order
    monkeypatch.setattr(site, "_in_order", lambda *a: rounds.append(1) or place(*a))
    got = told(spark, [(i, i + 1, 0) for i in range(500)], [0], [], None, 4)
    assert got == ([(i, i) for i in range(4)], True) and len(rounds) <= 6


def test_parts_are_written_as_one(spark):
    """Depths along a path longer than the parts that are kept apart."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(3, 3), (5, 1)], "src long, dst long")
    start = spark.createDataFrame([(0,)], "node long")
    assert sorted(tuple(r) for r in site.depths(edges, start).collect()) == [(i, i) for i in range(21)]
    assert site.depths(edges, start, 2).agg(F.max("depth")).first()[0] == 2


def test_intermediate_tables_can_be_deleted(spark):
    from pathlib import Path

    kept = site.saved(spark.range(3))
    folder = Path(kept.inputFiles()[0].removeprefix("file:").replace("//", "/")).parent
    assert folder.is_dir()
    site.forget(spark)
    assert not folder.exists() and site._MADE == []


def test_the_audit_of_the_whole_site_has_no_limit(spark, monkeypatch):
    from conftest import DATA

    from weftline import audit
    from weftline.plans.queries import QUERIES

    class Crawled(Exception):
        pass

    def crawl_order(edges, start, sitemap, fetched, limit):
        raise Crawled(limit)

    monkeypatch.setattr(site, "crawl_order", crawl_order)
    with pytest.raises(Crawled) as found:
        QUERIES["q_workflow"](spark, DATA)
    assert found.value.args == (None,) and audit.checked_options(limit=None)["limit"] is None
