"""Blocks against a plain model of the literal rule, on many small random graphs at once.

The graphs are disjoint ranges of ids in one edge list, so one run covers all.
"""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from vertexweave import operators as op

GRAPHS, STRIDE = 120, 100


def random_edges(seed):
    rng = random.Random(seed)
    edges = []
    for g in range(GRAPHS):
        size = rng.randint(2, 9)
        for _ in range(rng.randint(1, 2 * size)):
            a, b = rng.randrange(size), rng.randrange(size)
            if a != b:
                edges.append((g * STRIDE + a, g * STRIDE + b))
    return edges


def model(edges, mode, k):
    pairs = [e for e in edges] if mode == 1 else [(b, a) for a, b in edges]
    if mode == 3:
        pairs = list(edges) + pairs
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
    hop = [(a, b, 1, "B") for a, b in pairs]
    seen = list(hop)
    for h in range(2, k + 1):
        border = {}
        for a, v, _, t in hop:
            if t == "B":
                border.setdefault(v, set()).add(a)
        hop = []
        for v, anchors in border.items():
            for a in anchors if v in near else ():
                hop.append((a, v, h - 1, "I"))
                hop += [(a, w, h, "B") for w in near[v] if w != a]
        seen += hop
    merged = {}
    for a, v, d, t in seen:
        best, border = merged.get((a, v), (d, True))
        merged[a, v] = (min(best, d), border and t == "B")
    blocks = sorted((a, v, d, "B" if b else "I") for (a, v), (d, b) in merged.items())
    lone = sorted({x for e in edges for x in e} - set(near))
    return blocks, lone, sorted(hop)


@pytest.mark.parametrize("mode", [1, 2, 3])
@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_blocks_follow_the_literal_rule(edge_frame, mode, k):
    edges = random_edges(10 * k + mode)
    blocks, lone, _ = model(edges, mode, k)
    found = op.extended_vertex_blocks(edge_frame(edges), mode, k, keep_lone=True, tile_side=1 + k % 3).cache()
    assert rows(found.where(F.col("vertex").isNotNull())) == blocks
    assert rows(found.where(F.col("vertex").isNull()).select("anchor")) == [(v,) for v in lone]


@pytest.mark.parametrize("mode", [1, 2, 3])
def test_literal_hops_and_merge(edge_frame, mode):
    edges = random_edges(mode)
    frame = edge_frame(edges)
    first = op.vertex_blocks(frame, mode)
    second = op.expand_hop(first, frame, mode, 2, tile_side=2)
    third = op.expand_hop(second, frame, mode, 3)
    assert rows(second) == model(edges, mode, 2)[2]
    assert rows(third) == model(edges, mode, 3)[2]
    assert rows(op.merge_hops([first, second, third])) == model(edges, mode, 3)[0]
