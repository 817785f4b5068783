"""Rounds of the frontier against a plain queue."""

import random
from collections import deque

from loamstone.operators import frontier


def graph(n, seed=1):
    r = random.Random(seed)
    return [(f"t{i}", f"t{min(int(r.expovariate(3 / n)), n - 1)}", j) for i in range(n) for j in range(r.randint(0, 5))]


def plain(links, seeds, done, rounds, batch, most):
    out, queue, seen_done = {}, deque(seeds), set(done)
    for t, link, _ in sorted(links, key=lambda x: (x[0], x[2])):
        out.setdefault(t, []).append(link)
    history = []
    for _ in range(rounds):
        known = {*queue, *seen_done}
        taken = [queue.popleft() for _ in range(min(batch, len(queue)))]
        for t in taken:
            for link in out.get(t, ()):
                if link not in known:
                    known.add(link)
                    queue.append(link)
        seen_done |= set(taken)
        queue = deque(list(queue)[:most])
        history.append((taken, list(queue)))
    return history


def run(spark, tmp_path, links, seeds, done, rounds, batch, most):
    edges = spark.createDataFrame(links, "topic string, link string, ord int")
    waiting = spark.createDataFrame([(t, i) for i, t in enumerate(seeds)], "topic string, pos long")
    finished = spark.createDataFrame([(t,) for t in done], "topic string")
    history = []
    for i in range(rounds):
        parts = []
        for name, df in zip(("taken", "waiting", "done"), frontier.expand(waiting, finished, edges, batch, most), strict=True):
            df.write.parquet(f"{tmp_path}/{i}/{name}")
            parts.append(spark.read.parquet(f"{tmp_path}/{i}/{name}"))
        taken, waiting, finished = parts
        history.append(tuple([r.topic for r in df.orderBy("pos").collect()] for df in (taken, waiting)))
    return history


def test_rounds_equal_a_plain_queue(spark, tmp_path):
    links = [*graph(20_000), ("t1", None, 9), (None, "t5", 0)]
    for n, most in enumerate((None, 40)):
        args = ([x for x in links if None not in x], ["t1", "t2", "t3"], ["t7"], 4, 25, most or 10**9)
        assert run(spark, tmp_path / str(n), links, ["t1", "t2", "t3"], ["t7"], 4, 25, most) == plain(*args)


def test_nothing_waits(spark, tmp_path):
    assert run(spark, tmp_path, graph(10), [], [], 1, 5, None) == [([], [])]
