import numpy as np

from texelflow.codecs.bits import Bits, Huffman, MoveToFront, crc16
from texelflow.streaming import video


def test_bits():
    b = Bits(bytes([0xB2, 0x03]))
    assert [b.take(n) for n in (1, 1, 4, 4)] == [0, 1, 12, 14]
    assert b.take(8) == 0  # past the end
    assert Bits(b"\x06").truncated(5) == 2
    assert Bits(b"\x0f").chunked(2) == 7
    h, b = Huffman([1, 1]), Bits(b"\x02")
    assert [h.read(b), h.read(b)] == [0, 1]


def test_history_and_crc():
    m = MoveToFront(4)
    for v in (5, 6):
        m.add(v)
    assert m.use(3) == 6 and m.values[1] == 6
    assert crc16(bytes([1])) == 3630 and crc16(bytes([255, 0, 1, 128, 127])) == 6028


def test_video_frames(spark, tmp_path):
    rows = [("v", 0, False, f, 6, [f % 6, (f * 5) % 6], [f * 10, f]) for f in range(7)]
    schema = "path string, level int, is_alpha boolean, frame int, n_blocks int, places array<int>, values_ array<int>"
    got = {r["frame"]: r["blocks"] for r in video.frames(spark.createDataFrame(rows, schema)).collect()}
    for f in range(7):  # replay from the first frame
        state = None
        for r in rows[: f + 1]:
            state = video.step(state, r[5], r[6], 6)
        assert got[f] == state.tolist()
    for k in range(2):  # two micro-batches, in order
        spark.createDataFrame(rows[4 * k : 4 * k + 4], schema).coalesce(1).write.json(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = video.streamed(stream).writeStream.format("memory").queryName("video_out").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["frame"]: r["blocks"] for r in spark.table("video_out").collect()} == got
    assert np.array(got[6]).shape == (6,)
