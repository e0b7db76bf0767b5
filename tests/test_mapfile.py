import numpy as np
import pytest

from loomgrid.operators.atlas import Atlas
from loomgrid.sources import mapfile as m

GOLDEN = [1, 2, 3, 4, 2, 1, 5, 6, 7, 8, 11, 12, 9, 10, 13, 14]


def golden(size=4):
    packed = m.pack(bytes.fromhex("700708090a"))
    blocks = bytes.fromhex("00" + "43010260") + bytes.fromhex("10" + "05" + "7003040506") + bytes([0x20, len(packed)]) + packed + bytes.fromhex("00" + "700b0c0d0e")
    return bytes([size, size, 1]) + blocks


def test_golden():
    assert m.decode_image(golden()).ravel().tolist() == GOLDEN
    assert m.decode_image(golden(3)).tolist() == np.array(GOLDEN).reshape(4, 4)[:3, :3].tolist()


@pytest.mark.parametrize("v", [0, 251, 252, 507, 508, 66043, 66044, 16843259, 16843260, 4311810555])
def test_numbers(v):
    from loomgrid.sources.mapfile import Bits, BitWriter

    b = BitWriter().put(1, 3).unsigned(v).signed(-min(v, 4311810427)).signed(min(v, 4311810427)).done()
    r = Bits(b)
    assert (r.take(3), r.unsigned(), r.signed(), r.signed()) == (1, v, -min(v, 4311810427), min(v, 4311810427))


@pytest.mark.parametrize("seed", range(20))
def test_pack(seed):
    rng = np.random.default_rng(seed)
    data = rng.integers(0, rng.integers(1, 6), int(rng.integers(0, 900))).astype(np.uint8).tobytes()
    assert m.unpack(m.pack(data))[: len(data)] == data


@pytest.mark.parametrize("seed", range(20))
def test_round_trip(seed):
    rng = np.random.default_rng(seed)
    codes = rng.integers(0, int(rng.choice([1, 2, 4, 9, 400, 10**6])), (int(rng.integers(1, 40)), int(rng.integers(1, 40))))
    side = int(rng.choice([1, 2, 8, 16, 32]))
    assert (m.decode_image(m.encode_image(codes, side)) == codes).all()


@pytest.mark.parametrize("mode", range(4))
def test_scans_are_whole(mode):
    assert sorted(m.scan_cells(8, mode).tolist()) == list(range(64))
    assert m.scan_cells(2, mode).tolist() == [[0, 1, 3, 2], [1, 0, 2, 3], [0, 2, 3, 1], [3, 1, 0, 2]][mode]


def test_run_cell_and_container():
    # a run cell of two values, scanned zigzag: 3 x 5, then 1 x 9
    w = m.BitWriter().put(2 << 6, 8).put(0, 1).put(3, 2).put(0, 4).unsigned(5).unsigned(9).unsigned(3).unsigned(1)
    # a container of values {4, 7} around it in its last quarter
    c = m.BitWriter().put(0b00_00_1100, 8).put(0b00_01_00_11, 8).unsigned(4).unsigned(7)
    inner = w.value, w.n
    c.put(inner[0], inner[1])
    got = m.BlockDecoder(m.Bits(c.done()), False).square(4)
    assert got.tolist() == [[4, 4, 7, 7], [4, 4, 7, 7], [4, 4, 5, 5], [4, 4, 9, 5]]


@pytest.mark.parametrize("bad", ["c0", "40ff", "0f", "30", "5f"])
def test_broken_cells(bad):
    with pytest.raises(ValueError):
        m.BlockDecoder(m.Bits(bytes.fromhex(bad)), False).square(4)


def test_files(spark, tmp_path):
    image = np.array(GOLDEN).reshape(4, 4)
    maps = [(10, 20, image), (11, 21, np.array([[0, 90], [0, 91]])), (30, -40, image)]
    data = m.encode_set(maps, 1, 1, header=b"HEAD", version=b"any/1", metadata="xyz", side=2)
    back = m.decode_set(data)
    assert (back["unit_x"], back["metadata"], len(back["maps"])) == (1, "xyz", 3)
    (tmp_path / "a.bin").write_bytes(data)
    rows = m.read_map_files(spark, str(tmp_path))
    runs = rows.select("map_ord", "y", "x0", "len", "code")
    atlas = Atlas(rows.select("map_ord", "west", "south", "width", "height").distinct(), runs, 1, 1)
    points = spark.createDataFrame([(30, -40), (12, 21), (0, 0)], "x long, y long")
    assert {(r.x, r.y): r.code for r in atlas.point_codes(points).collect()} == {(30, -40): 1, (12, 21): 5, (0, 0): None}
    with pytest.raises(ValueError):
        m.decode_set(data, max_maps=2)
    with pytest.raises(ValueError):
        m.decode_set(data[:-3])


def test_single_map():
    codes = np.arange(35).reshape(5, 7)
    data = m.encode_single(-3, 4, codes, 100, 50, header=b"HEAD", version=b"one/1", metadata="m", side=4)
    got = m.decode_single(data)
    west, south, back = got["maps"][0]
    assert (got["unit_x"], got["unit_y"], got["metadata"], west, south) == (100, 50, "m", -3, 4) and (back == codes).all()
    both = m.join_sets(got, got)
    assert len(both["maps"]) == 2
    with pytest.raises(ValueError):
        m.join_sets(got, got | {"unit_x": 1})
