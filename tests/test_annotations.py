"""Ground truth in both XML forms and in JSON; what can't be read is kept apart; verification tables."""

import json

from roadweave.sources import annotations, files

XML = """<?xml version="1.0" encoding="UTF-8"?>
<vehicles>
    <vehicle id="1">
        <plate>KW527</plate><type>car</type><make>Toyota</make><color>White</color><year>2019</year><motorcycle>0</motorcycle><quality>good</quality><discard>0</discard>
        <frame number="6"><plate x="110" y="210" width="179" height="66" /><vehicle x="60" y="110" width="798" height="370" /></frame>
        <frame number="1"><plate x="100" y="200" width="170" height="58" /><vehicle x="50" y="100" width="732" height="364" /></frame>
        <frame number="no"><plate x="1" y="2" width="3" height="4" /></frame>
        <frame id="9"><plate_bbox x1="a" y1="2" w="3" h="4" /><box x1="5" w="6" /></frame>
    </vehicle>
    <vehicle id="2" discard="TRUE" moto="1"><license_plate> </license_plate><colour>red</colour></vehicle>
</vehicles>
"""
OTHER = """<GroundTruthRoot><gtruth>
<vehicle placa="TN01AB1234" iframe="17" moto="true"><region x="1" y="2" w="3" h="4"/></vehicle>
<vehicle plate="true" iframe="x"/>
<vehicle plate="MH12CD2222" iframe="18" brand="b"/>
</gtruth></GroundTruthRoot>
"""


def write(folder, name, content):
    (folder / name).write_text(content, encoding="utf-8")


def test_xml(spark, tmp_path):
    write(tmp_path, "a.xml", XML)
    write(tmp_path, "b.xml", OTHER)
    good, bad = annotations.xml_vehicles(spark, str(tmp_path), "CAM_A")
    got = {r.vehicle_gt_id: r for r in good.collect()}
    assert set(got) == {"KW527", "CAM_A_V2", "TN01AB1234", "CAM_A_Vx", "MH12CD2222"} and bad.collect() == []
    one = got["KW527"]
    assert (one.raw_id, one.vehicle_type, one.make, one.model, one.discard, one.observation_count, one.min_frame, one.max_frame) == ("1", "car", "Toyota", "", False, 3, 1, 9)
    assert [(o.frame, o.plate_box, o.vehicle_box) for o in one.observations] == [(1, [100.0, 200.0, 170.0, 58.0], [50.0, 100.0, 732.0, 364.0]), (6, [110.0, 210.0, 179.0, 66.0], [60.0, 110.0, 798.0, 370.0]), (9, None, [5.0, 0.0, 6.0, 0.0])]
    two = got["CAM_A_V2"]
    assert (two.vehicle_type, two.color, two.motorcycle, two.discard, two.quality, two.observation_count, two.min_frame) == ("motorcycle", "red", True, True, "good", 0, 0)
    assert [(o.frame, o.plate_box, o.vehicle_box) for o in got["TN01AB1234"].observations] == [(17, [1.0, 2.0, 3.0, 4.0], None)]
    assert [o.frame for o in got["CAM_A_Vx"].observations] == [0] and got["MH12CD2222"].make == "b"
    assert annotations.boxes_of(good).count() == 6


def test_malformed_xml_is_kept_apart(spark, tmp_path):
    write(tmp_path, "a.xml", "<vehicles><vehicle id='1'><plate>KW527</plate></vehicle></vehicles>")
    write(tmp_path, "b.xml", "<vehicles><vehicle id='2'><plate>KW5</wrong></vehicle></vehicles>")
    good, bad = annotations.xml_vehicles(spark, str(tmp_path), "C")
    assert [r.vehicle_gt_id for r in good.collect()] == ["KW527"] and bad.count() == 1


def test_json(spark, tmp_path):
    item = {"plate": "tn 01 ab 1234", "camera_id": "CAM_A_EAST", "frames": [{"frame_id": 5, "bbox": [1, 2, 3, 4]}, {"frame": 2, "plate": [5, 6, 7, 8]}], "motorcycle": True}
    write(tmp_path, "a.json", json.dumps({"vehicles": [item, {"id": 7, "camera_id": "CAM_B"}, {"type": "bus"}]}))
    write(tmp_path, "b.json", json.dumps([{"id": 9, "observations": [{"frame": 1}], "discard": True}]))
    write(tmp_path, "c.json", json.dumps({"annotations": [{"vehicle_id": "v", "license_plate": ""}]}))
    write(tmp_path, "d.json", '{"vehicles": [')
    good, bad = annotations.json_vehicles(spark, str(tmp_path), "CAM_A")
    got = {r.vehicle_gt_id: r for r in good.collect()}
    assert set(got) == {"TN01AB1234", "CAM_A_V2", "CAM_A_V9", "CAM_A_Vv"} and bad.count() == 1
    one = got["TN01AB1234"]
    assert (one.raw_id, one.motorcycle, one.vehicle_type) == ("0", True, "car")
    assert [(o.frame, o.plate_box, o.vehicle_box) for o in one.observations] == [(2, [5.0, 6.0, 7.0, 8.0], None), (5, None, [1.0, 2.0, 3.0, 4.0])]
    assert got["CAM_A_V2"].vehicle_type == "bus" and got["CAM_A_V9"].discard and got["CAM_A_V9"].observation_count == 1


def test_verification_table(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.createDataFrame([("plate_crop_001.png", 7, "T1", 1.23456, 'say "TN", 01\nx', "TN01", 0.98765, 0.5, "VALID", "", 1.0, 99)], "crop_id string, frame_number long, track_id string, timestamp double, raw_ocr string, normalized_ocr string, ocr_confidence double, plate_detector_confidence double, indian_format string, indian_validation_reason string, temporal_consistency double, more int")
    files.append_verification(rows, path)
    files.append_verification(rows.withColumnRenamed("more", "other"), path)
    got = files.verification(spark, path)
    assert got.columns == ["crop_id", "frame_number", "track_id", "timestamp", "raw_ocr", "normalized_ocr", "ocr_confidence", "plate_detector_confidence", "indian_format", "indian_validation_reason", "temporal_consistency", "human_ground_truth", "human_result"]
    assert [(r.frame_number, r.timestamp, r.raw_ocr, r.ocr_confidence, r.human_result or "") for r in got.collect()] == [(7, 1.235, 'say "TN", 01\nx', 0.988, "")] * 2


def test_a_file_is_read_once(spark, tmp_path):
    """Numbers in fields of text were fetched from the file one by one."""
    frames = ", ".join(f'{{"frame": {k}, "bbox": [1, 2, 3, 4]}}' for k in range(20_000))
    (tmp_path / "a.json").write_text(f'{{"vehicles": [{{"id": 7, "plate": "TN01AB1234", "frames": [{frames}]}}]}}')
    read = lambda: sum(s.getBytesRead() for s in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())
    before = read()
    got = annotations.json_vehicles(spark, str(tmp_path), "CAM")[0].collect()
    assert [(r.raw_id, r.observation_count, r.min_frame, r.max_frame) for r in got] == [("7", 20_000, 0, 19_999)]
    assert read() - before < 20 * (tmp_path / "a.json").stat().st_size
