"""Stored relations and degrees after random changes equal a rebuild."""

import random

from quillgraph.operators import maintained as m
from quillgraph.operators.analytics import cut

EVIDENCE = "src_id string, predicate string, dst_id string, chunk_id string, strength int, description string, seq long"


def test_random_changes_equal_a_rebuild(spark):
    rnd = random.Random(7)
    evidence, mentions = {}, set()
    frame = lambda rows: spark.createDataFrame([(*k, *v) for k, v in sorted(rows.items())], EVIDENCE)
    ends = lambda rows: spark.createDataFrame(sorted(rows), "chunk_id string, entity_id string")
    relations, degrees = m.rebuilt(frame({}), ends(set()))
    for step in range(5):
        old, old_mentions = dict(evidence), set(mentions)
        if step % 2:  # chunks go; their relations lose their descriptions
            gone = {f"c{rnd.randrange(step * 10)}" for _ in range(8)}
            lost = {k[:3] for k in evidence if k[3] in gone}
            evidence = {k: (v[0], "" if k[:3] in lost else v[1], v[2]) for k, v in evidence.items() if k[3] not in gone}
            mentions = {x for x in mentions if x[0] not in gone}
        else:
            for n in range(40):
                a, b, c = f"e{rnd.randrange(6)}", f"e{rnd.randrange(6)}", f"c{step * 10 + rnd.randrange(10)}"
                evidence.setdefault((a, rnd.choice("pq"), b, c), (rnd.randint(1, 10), "x" * rnd.randrange(4) + str(n), 100 * step + n))
                mentions |= {(c, a), (c, b)}
        touched = lambda rows: {k: v for k, v in rows.items() if k in old.keys() ^ evidence.keys()}  # noqa: B023, E731
        tables = {"relations": relations, "degrees": degrees}
        out = m.changes(lambda n, keys: tables[n], (frame(touched(old)), frame(touched(evidence))), ends(mentions - old_mentions), ends(old_mentions - mentions), cut)
        relations, degrees = (cut(tables[n].join(g, g.columns, "left_anti").unionByName(rows)) for n, (g, rows) in out.items())
        want = m.rebuilt(frame(evidence), ends(mentions))
        got = sorted(tuple(r)[:6] for r in relations.collect())
        assert got == sorted(tuple(r)[:6] for r in want[0].collect()), step
        assert sorted(map(tuple, degrees.collect())) == sorted(map(tuple, want[1].collect())), step
