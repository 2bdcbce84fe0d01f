"""Runs with configurations and logs of changing fields."""

from simloom.sources import runs

LOGS = {
    "sweep__a": ("model: {pooling: mean}\nslicing: {slice_width: 16, stride: 8, remove_padding: true}\n", "epoch,val_auc,note\n1,0.5,warm\n2,0.75,\n3,0.75,x\n"),
    "sweep__b": ('{"model": {"pooling": 3}, "rendering": {"background": "white", "dpi": [1, 2]}, "slicing": {"slice_width": "wide"}}', "epoch,loss,val_auc\r\n1,0.1,nan\r\n2,,1e-1\r\n"),
    "sweep__c": ("model: {}\n", "epoch,loss\n1,2.5\n"),
    "sweep__no_log": ("model: {}\n", None),
    "sweep__no_config": (None, "epoch,val_auc\n1,0.9\n"),
    "sweep__broken": ("{", "epoch,val_auc\n1,0.9\n"),
    "other": ("model: {}\n", "epoch,val_auc\n1,0.9\n"),
}


def test_run_table(spark, tmp_path):
    for run, (config, log) in LOGS.items():
        (tmp_path / run).mkdir()
        for name, text in (("config.yaml", config), ("log.csv", log)):
            if text is not None:
                (tmp_path / run / name).write_bytes(text.encode())
    rows = {r.run: r for r in runs.run_table(spark, f"{tmp_path}/sweep__*").collect()}
    assert sorted(rows) == ["sweep__a", "sweep__b", "sweep__c"]
    assert tuple(rows["sweep__a"])[1:] == (3, 0.75, 2, "mean", True, "unknown", 16.0, 8.0, "overlapping")
    assert tuple(rows["sweep__b"])[1:] == (2, 0.1, 2, "3", False, "white", None, None, "non-overlapping")
    assert tuple(rows["sweep__c"])[1:4] == (1, None, None)
    logs = {(r.run, r.line): r.j for r in runs.run_logs(spark, f"{tmp_path}/sweep__*/log.csv").selectExpr("run", "line", "to_json(row) AS j").collect()}
    assert logs["sweep__a", 1] == '{"epoch":1,"note":"warm","val_auc":0.5}' and logs["sweep__a", 2] == '{"epoch":2,"val_auc":0.75}' and logs["sweep__b", 1] == '{"epoch":1,"loss":0.1,"val_auc":"nan"}'
    schema = runs.varying_fields(runs.run_configs(spark, f"{tmp_path}/sweep__*/config.yaml")).first()[0]
    assert "pooling: VARIANT" in schema and "background: STRING" in schema and "dpi: ARRAY<BIGINT>" in schema
    assert runs.varying_fields(runs.run_configs(spark, f"{tmp_path}/other/config.yaml").limit(0)).first()[0] == "VOID"
