"""An E57 scan in several tasks: ranges begin within packets, and streams of other widths run ahead of one another."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.sources import e57


@pytest.fixture(scope="module")
def scan(spark, tmp_path_factory):
    n, path = 40_000, f"{tmp_path_factory.mktemp('e57')}/a.e57"
    k = F.col("id")
    e57.write_e57(spark.range(n).select(k.alias("gid"), F.sqrt(k.cast("double")).alias("x"), (k * 0.5).alias("y"), (-k * 1.0).alias("z"), *[(k % m).cast("int").alias(c) for c, m in zip("rgb", (251, 241, 256), strict=True)]), path)
    return path, n


@pytest.mark.parametrize("size", [777, 20_000, 10**6])
def test_ranges_are_the_whole_scan(spark, scan, size):
    path, n = scan
    got = e57.read_e57(spark, path, size=size)
    tasks = got.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks == 1 if size > n else tasks > min(8, n // size) // 2
    rows = got.orderBy("gid").toPandas()
    k = np.arange(n)
    assert (rows.gid == k).all() and np.allclose(rows.x, np.sqrt(k)) and (rows.y == k * 0.5).all() and (rows.r == k % 251).all() and (rows.b == k % 256).all()
    assert e57.read_e57(spark, path, stride=7, size=size).count() == -(-n // 7)


class Packets:
    """A scan in memory: packets in which each stream has as many bytes as it happens to."""

    def __init__(self, packets):
        self.packets, self.at, place = packets, {}, 0
        for p in packets:
            self.at[place] = p
            place += len(p)

    def read(self, at, length):
        return self.at[at][:length]

    @staticmethod
    def after(at, length):
        return at + length


def test_streams_out_of_step(monkeypatch):
    rng, n = np.random.default_rng(5), 5000
    fields = [{"name": name, "kind": "Integer", "low": 0, "high": 2**bits - 1, "scale": 1.0, "offset": 0.0, "double": True} for name, bits in (("a", 3), ("b", 17), ("c", 0), ("d", 11))]
    values = {f["name"]: rng.integers(0, f["high"] + 1, n) for f in fields}
    flat = []
    for f in fields:
        bits = e57._bits(f)
        flat.append(np.packbits((values[f["name"]][:, None] >> np.arange(bits) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes() if bits else b"")
    packets = []
    while any(flat):
        if rng.random() < 0.2:
            packets.append(bytes([0, 0]) + (15).to_bytes(2, "little") + bytes(12))  # an index packet
        take = [int(rng.integers(0, 400)) for _ in flat]
        parts = [s[:t] for s, t in zip(flat, take, strict=True)]
        flat = [s[t:] for s, t in zip(flat, take, strict=True)]
        body = (4).to_bytes(2, "little") + b"".join(len(p).to_bytes(2, "little") for p in parts) + b"".join(parts)
        packets.append(bytes([1, 0]) + (len(body) + 3).to_bytes(2, "little") + body)
    monkeypatch.setattr(e57, "_Pages", lambda path: Packets(packets))
    monkeypatch.setattr(e57, "_first_packet", lambda pages, scan: 0)
    scan = {"fields": fields, "count": n, "at": 0}
    for size in (1, 97, 1000, n):
        ranges = list(e57._ranges("", scan, size))
        assert [r[0] for r in ranges] == list(range(0, n, size))
        for first, packet, before in ranges[:: max(1, len(ranges) // 60)]:
            count = min(size, n - first)
            got = list(e57._records("", scan, first, count, packet, before))
            for name in "abcd":
                assert (np.concatenate([g[name] for g in got]) == values[name][first : first + count]).all()
    constant = {"fields": [fields[2]], "count": 10, "at": 0}
    assert [len(g["c"]) for g in e57._records("", constant)] == [10] and len(list(e57._ranges("", constant, 3))) == 1
