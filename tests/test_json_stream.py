"""Streamed JSON: members of files cut into many blocks equal what a JSON parser gives."""

from __future__ import annotations

import json
import random

import pytest

from partita.sources import json_stream, readers


def strange(rng):
    return "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", ":", "a", "é", "漢", "\n", "\t", " ", '"},{"', '"images": [{']) for _ in range(rng.randint(0, 12)))


def document(rng, n, form):
    nested = lambda k: {"id": k, "note": strange(rng), "more": {"deep": [{"x": strange(rng)}, [1, [2, {}]]], "none": None}, "list": []}
    doc = {"info": {"year": 2024, strange(rng) + "k": strange(rng)}, "tags": [1, "}", ["]"]], "note": strange(rng)}
    things = {str(k) + strange(rng): nested(k) for k in range(n)}
    doc["things"] = list(things.values()) if form % 2 else things
    doc["meta"] = [[{"a": [{"b": 1}]}], {"c": strange(rng)}]
    doc["names"] = {str(k): strange(rng) for k in range(5)} if form % 3 else {}
    doc["empty"] = []
    doc["last"] = [{}, {"z": strange(rng)}]
    return doc


def expected(doc):
    out = []
    for section, value in doc.items():
        if isinstance(value, list):
            out += [(section, None, False, v) for v in value if isinstance(v, dict)]
        elif isinstance(value, dict):
            out += [(section, k, False, v) for k, v in value.items() if isinstance(v, dict)]
            plain = {k: v for k, v in value.items() if not isinstance(v, dict)}
            out += [(section, None, True, plain)] if plain else []
    return out


@pytest.mark.parametrize("block, indent", [(150, None), (1000, 2), (1 << 20, None)])
def test_members_equal_a_parser(spark, tmp_path, block, indent):
    rng, docs = random.Random(block), {}
    for k in range(6):
        docs[f"{k}.json"] = document(rng, rng.choice([0, 1, 30]), k)
        (tmp_path / f"{k}.json").write_text(json.dumps(docs[f"{k}.json"], indent=indent, ensure_ascii=k % 2 == 0) + ("\n" if k % 2 else ""))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        rows = json_stream.json_members(spark, str(tmp_path), run=7).orderBy("file", "member").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    for name, doc in docs.items():
        got = [(r.section, None if r.key is None else json.loads(f'"{r.key}"'), r.scalars, json.loads(r.value)) for r in rows if r.file.endswith("/" + name)]
        want = expected(doc)
        for section in doc:  # an array's inner arrays come along with its next object
            if section == "meta":
                assert [g for g in got if g[0] == section] == [(section, None, False, doc["meta"][-1])]
            else:
                assert [g for g in got if g[0] == section] == [w for w in want if w[0] == section]


def test_annotations_equal_the_text_reader(spark, tmp_path):
    rng = random.Random(8)
    images = [{"id": k, "file_name": f"{k}{strange(rng)}.png", "width": 100, "height": 50} for k in range(20)]
    notes = [{"id": str(k), "img_id": str(k % 22), "cat_id": [str(k % 4), str(k % 6)], "a_bbox": [k, 0.5, k + 2, 9], "comments": strange(rng)} for k in range(60)]
    lists = {"info": {"x": "}"}, "images": images, "annotations": notes, "categories": [{"id": k, "name": f"c{k}"} for k in range(5)]}
    maps = {"categories": {str(k): {"name": f"m{k}", "set": "x"} for k in range(5)}, "images": {str(i["id"]): i for i in images}, "annotations": {n["id"]: {**n, "image_id": n["img_id"], "bbox": [1, 2, 3, 4]} for n in notes}}
    named = {"images": images[:3], "annotations": notes, "categories": {"0": "zero", "1": "one}"}}
    for name, doc in (("lists", lists), ("maps", maps), ("named", named)):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = sorted(map(str, readers.read_annotations(spark, str(tmp_path)).collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    whole = spark.read.text(str(tmp_path), wholetext=True).selectExpr("_metadata.file_path AS file", "value")
    assert got == sorted(map(str, readers.annotation_boxes(whole).collect())) and len(got) > 200


def test_a_section_of_empty_objects(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": {}, "b": [], "c": {"k": {}}, "d": {"x": 1}}')
    (tmp_path / "b.json").write_text("{}")
    got = [(r.section, r.key, r.value) for r in json_stream.json_members(spark, str(tmp_path)).orderBy("member").collect()]
    assert got == [("c", "k", "{}"), ("d", None, '{"x": 1}')]
