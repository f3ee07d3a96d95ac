"""Pictures told whole from their codes, and the committed folder of an ingest."""

import csv
import json

import pytest

from skyfix.operators import frames as fr
from skyfix.sources import ingest, jpeg

DC, AC = [0, 1, 2, 3, 4, 5, 6, 7], [0x00, 0x01, 0x11, 0xF0, 0x02]  # codes of four and of three bits


def picture(values, width=64, height=40, restart=0):
    """A grey baseline stream of flat and barely structured blocks; one number a block."""
    counts = lambda n, at: bytes(n if i == at else 0 for i in range(1, 17))
    seg = lambda mark, body: bytes([0xFF, mark]) + (len(body) + 2).to_bytes(2) + body
    head = b"\xff\xd8" + seg(0xDB, bytes([0]) + bytes([8] * 64)) + seg(0xC0, bytes([8]) + height.to_bytes(2) + width.to_bytes(2) + bytes([1, 1, 0x11, 0]))
    head += seg(0xC4, bytes([0x00]) + counts(8, 4) + bytes(DC) + bytes([0x10]) + counts(5, 3) + bytes(AC)) + (seg(0xDD, restart.to_bytes(2)) if restart else b"") + seg(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    blocks, body, bits, last, turn = -(-width // 8) * -(-height // 8), b"", "", 0, 0

    def flush(bits):
        bits += "1" * (-len(bits) % 8)
        return int(bits or "0", 2).to_bytes(len(bits) // 8).replace(b"\xff", b"\xff\x00") if bits else b""

    for i in range(blocks):
        if restart and i and i % restart == 0:
            body, bits, last = body + flush(bits) + bytes([0xFF, 0xD0 + turn]), "", 0
            turn = (turn + 1) % 8
        v = values[i % len(values)]
        d, last = v - last, v
        size = abs(d).bit_length()
        bits += f"{size:04b}" + (f"{d if d > 0 else d + (1 << size) - 1:0{size}b}" if size else "")
        bits += "001" + "1" + "011" + "010" + "0" + "000" if i % 3 == 0 else "000"  # a coefficient, sixteen zeros, one after a zero; or none
    return head + body + flush(bits) + b"\xff\xd9"


def test_whole_pictures_are_told_from_broken_ones():
    good = [picture([5, -3, 0, 60, -60, 7]), picture([1, 2, 3], 17, 9), picture([9, -9, 60], restart=3)]
    assert [jpeg.problem(g) for g in good] == [None] * 3 and [jpeg.problem(g, codes=False) for g in good] == [None] * 3
    for g in good:
        for cut in (0, 1, 10, len(g) // 2, len(g) - 3, len(g) - 1):
            assert jpeg.problem(g[:cut]) and jpeg.problem(g[:cut] + b"\xff\xd9")
        assert jpeg.problem(g + b"x") and jpeg.problem(g + g)
        assert jpeg.problem(g[:-12] + g[-7:])  # a piece of the codes is gone
    a, b = picture([5, -3, 0, 60, -60, 7]), picture([50, 51, 52, 49])
    assert jpeg.problem(a[: len(a) // 2] + b[len(b) // 2 :]) or len(a) == len(b)
    third = good[2]
    at = third.index(b"\xff\xd1")
    assert jpeg.problem(third[:at] + b"\xff\xd3" + third[at + 2 :]) == "restart markers out of turn"
    flips = [bytearray(good[0]) for _ in range(40)]
    start = good[0].index(b"\xff\xda") + 10
    for i, f in enumerate(flips):
        f[start + i % (len(f) - start - 2)] ^= 1 << (i % 8)
    told = sum(jpeg.problem(bytes(f)) is not None for f in flips)
    assert told >= 20  # others change a value and no code's length, which only a digest tells


VIDEO = {"name": "v.mp4", "size_bytes": 7, "n_frames": 120, "fps": 30.0, "width": 64, "height": 40}
SETTINGS = {"every_n_seconds": 1.0}


def _pictures(spark, n=24):
    rows = [(i // 10, i * 5, i * 1000, 3.14159 + i, f"frame_{i * 5:06d}_t{i * 1000:08d}ms.jpg", bytearray(picture([i, -i, 3]))) for i in range(n)]
    return spark.createDataFrame(rows, "shard int, index long, t_ms long, blur_score double, filename string, content binary").repartition(5)


def test_a_folder_is_written_resumed_and_verified(spark, tmp_path):
    out, shots = str(tmp_path / "out"), _pictures(spark)
    assert ingest.ingest(spark, shots, out, VIDEO, SETTINGS, cap=13) == ingest.Ingested(3, 13, 0, False)
    head = ingest.manifest_of(out)
    assert head["shards"] == {"0": "complete", "1": "partial"} and not head["completed"]
    assert ingest.ingest(spark, shots, out, VIDEO, SETTINGS) == ingest.Ingested(3, 14, 10, True)
    assert ingest.ingest(spark, shots, out, VIDEO, SETTINGS) == ingest.Ingested(3, 0, 24, True)
    with open(f"{out}/frames.csv", newline="") as f:
        rows = list(csv.DictReader(f))
    assert list(rows[0]) == ["shard", "index", "t_ms", "blur_score", "filename", "bytes", "sha1"]
    assert [(int(r["shard"]), int(r["index"])) for r in rows] == [(i // 10, i * 5) for i in range(24)] and rows[0]["blur_score"] == "3.14"
    manifest = json.loads((tmp_path / "out" / "manifest.json").read_text())
    assert manifest["video"] == VIDEO and list(manifest["shards"]) == ["0", "1", "2"] and manifest["completed"] is True
    assert manifest["shards"]["2"]["frames"][0] == {"index": 100, "t_ms": 20000, "blur_score": 23.14, "filename": rows[20]["filename"], "bytes": int(rows[20]["bytes"]), "sha1": rows[20]["sha1"]}
    assert {r.problem for r in ingest.verify(spark, out).collect()} == {None}
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_pieces") or ".json." in p.name]

    shard = tmp_path / "out" / "shards" / "shard_0001"
    (shard / rows[10]["filename"]).unlink()
    (shard / rows[11]["filename"]).write_bytes((shard / rows[11]["filename"]).read_bytes()[:-9] + b"\xff" * 9)
    checked = ingest.verify(spark, out)
    assert sorted((r.filename, r.problem) for r in checked.where("problem is not null").collect()) == [(f"shard_0001/{rows[10]['filename']}", "missing"), (f"shard_0001/{rows[11]['filename']}", "sha1")]
    assert ingest.demote(spark, out, checked) == [1] and ingest.manifest_of(out)["completed"] is False
    assert ingest.ingest(spark, shots, out, VIDEO, SETTINGS) == ingest.Ingested(3, 10, 14, True)
    assert {r.problem for r in ingest.verify(spark, out).collect()} == {None}

    (tmp_path / "out" / "frames.csv").unlink()
    assert [(r.filename, r.problem) for r in ingest.verify(spark, out).where("problem is not null").collect()] == [("frames.csv", "missing")]
    assert ingest.ingest(spark, shots, out, VIDEO, SETTINGS).n_written == 0 and (tmp_path / "out" / "frames.csv").exists()
    with pytest.raises(fr.IngestMismatchError, match="n_frames, settings"):
        ingest.ingest(spark, shots, out, VIDEO | {"n_frames": 1}, {"every_n_seconds": 2.0})
    assert ingest.ingest(spark, shots.limit(3), out, VIDEO, {"every_n_seconds": 2.0}, force=True).n_written == 3


def test_a_failing_task_leaves_the_run_before(spark, tmp_path):
    out, shots = str(tmp_path / "out"), _pictures(spark)
    ingest.ingest(spark, shots, out, VIDEO, SETTINGS, cap=10)
    before = (tmp_path / "out" / "manifest.json").read_bytes(), (tmp_path / "out" / "frames.csv").read_bytes()
    broken = shots.selectExpr("shard", "index", "t_ms", "blur_score", "filename", "if(index = 75, substring(content, 1, 40), content) as content")
    with pytest.raises(Exception, match="write verification"):
        ingest.ingest(spark, broken, out, VIDEO, SETTINGS)
    assert before == ((tmp_path / "out" / "manifest.json").read_bytes(), (tmp_path / "out" / "frames.csv").read_bytes())
    assert ingest.ingest(spark, shots, out, VIDEO, SETTINGS).completed
    assert ingest.verify(spark, str(tmp_path / "none")).first().problem == "no manifest.json"
