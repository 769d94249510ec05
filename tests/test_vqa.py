"""Question-answer records: kinds of image fields, places to look, violations."""

import json

from strandline.sources import counts, vqa


def test_records_and_places(spark, tmp_path):
    for name in ("set/a.png", "set/sub/b.png", "root/data/c.png", "root/d.png", "far/e.png", "root/data/a.png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    turn = [{"from": "human", "value": "<image> what?"}, {"from": "gpt", "value": "that"}]
    lines = [
        {"conversations": turn, "image": "a.png", "source": "s", "data_path": "data"},
        {"conversations": turn, "image": ["sub/b.png", None, "a.png"]},
        {"conversations": turn, "image": "c.png", "data_path": "data"},
        {"conversations": turn, "image": "d.png"},
        {"conversations": turn, "image": "e.png", "data_path": str(tmp_path / "far")},
        {"conversations": [], "image": str(tmp_path / "far/e.png")},
        {"conversations": turn, "image": "gone.png"},
        {"conversations": turn},
        {"conversations": turn, "image": [None]},
    ]
    text = "\n".join([json.dumps(x) for x in lines] + ["", "{bad"])
    (tmp_path / "set/vqa.jsonl").write_text(text)
    found, broken = vqa.records(spark, str(tmp_path / "set/vqa.jsonl"))
    assert {r.line: r.reason for r in broken.collect()} == {8: "no image", 9: "no image", 11: "bad JSON"}
    files = counts.listed(spark, str(tmp_path), "*.png")
    done, lost = vqa.resolved(found, files, str(tmp_path / "set"), str(tmp_path / "root"))
    rows = {r.line: r for r in done.collect()}
    at = lambda *names: [f"{tmp_path}/{n}" for n in names]
    assert {k: r.images for k, r in rows.items()} == {
        1: at("set/a.png"), 2: at("set/sub/b.png", "set/a.png"), 3: at("root/data/c.png"), 4: at("root/d.png"), 5: at("far/e.png"), 6: at("far/e.png"),
    }
    assert rows[1].source == "s" and [t["value"] for t in rows[1].conversations] == ["<image> what?", "that"] and rows[6].conversations == []
    assert {r.line: r.reason for r in lost.collect()} == {7: "image not found: gone.png"}
