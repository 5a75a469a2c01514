"""Clipping to catchments by communities, against the product of node sets."""

import random
from collections import Counter

import pytest

from urbanflow.model import Network
from urbanflow.operators import network, paths
from urbanflow.scratch import Scratch


def town(seed):
    """Six quarters with many streets inside and few between them, some rivers, a parallel edge and a lone node."""
    rng = random.Random(seed)
    near = [(f"{q}.{i}", f"{q}.{j}", 0, 1.0, None) for q in range(6) for i in range(8) for j in range(i) if rng.random() < 0.7]
    far = [(f"{q}.{rng.randrange(8)}", f"{p}.{rng.randrange(8)}", 0, 1.0, "street") for q in range(6) for p in range(6) if q != p]
    rivers = [(f"{q}.{i}", f"{(q + 1) % 6}.{i}", 0, 900.0, "river") for q in range(6) for i in range(8)]
    edges = {(e[0], e[1], e[2]): e for e in rivers + near + far}
    u, v, *_ = far[0]
    rows = [*edges.values(), (u, v, 1, 1.0, "street")]
    ids = sorted({f"{q}.{i}" for q in range(6) for i in range(8)}) + ["lone"]
    basins = [(i, rng.choice([None, 1, 2, 2, 3])) for i in ids]
    return ids, rows, basins


def cut(rows, basins, community, membership):
    """What is left once the product of each weak pair's node sets is taken away, both ways round."""
    basin = {i: -1 if b is None else b for i, b in basins}
    size, pairs = Counter(community.values()), Counter((community[i], basin[i]) for i in basin)
    gone = set()
    for (c, b), n in pairs.items():
        if n / size[c] <= membership:
            inside, others = [i for i in basin if community[i] == c], [i for i in basin if basin[i] == b and community[i] != c]
            gone |= {(x, y, 0) for i in inside for j in others for x, y in ((i, j), (j, i))}
    return sorted(r[:3] for r in rows if r[:3] not in gone)


@pytest.mark.parametrize("membership", [0.2, 0.5, 1.0])
def test_clip_by_given_communities(spark, membership):
    ids, rows, basins = town(1)
    community = {i: k % 4 for k, i in enumerate(ids)}
    net = Network(spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(rows, "u string, v string, key int, length double, edge_type string"))
    given = spark.createDataFrame(list(community.items()), "id string, community int")
    left = network.clip_to_catchments(net, spark.createDataFrame(basins, "id string, basin int"), "community", membership, given)
    assert left.edges.columns == net.edges.columns
    got = sorted((r["u"], r["v"], r["key"]) for r in left.edges.collect())
    assert got == cut(rows, basins, community, membership) and (membership == 0.2 or len(got) < len(rows))


def test_clip_by_own_communities(spark):
    ids, rows, basins = town(2)
    net = Network(spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(rows, "u string, v string, key int, length double, edge_type string"))
    label = network.street_communities(net, Scratch(spark, "t"))
    community = {r["id"]: r["community"] for r in label.collect()}
    assert set(community) == set(ids) and community["lone"] == "lone"
    streets = net.edges.where("coalesce(edge_type, 'street') = 'street'")
    quarters = spark.createDataFrame([(i, i.split(".")[0]) for i in ids], "id string, community string")
    assert paths.modularity(streets, label).first()["value"] >= paths.modularity(streets, quarters).first()["value"] - 1e-9
    left = network.clip_to_catchments(net, spark.createDataFrame(basins, "id string, basin int"), "community", 0.3)
    assert sorted((r["u"], r["v"], r["key"]) for r in left.edges.collect()) == cut(rows, basins, community, 0.3)
