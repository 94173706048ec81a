import struct

import numpy as np
import pytest

from lattica import ModelSpec, fit
from lattica.cli import main
from lattica.sources.config import load_config, strip_comment
from lattica.sources.panel import read_layout, read_panel, write_panel
from lattica.sources.synthetic import PanelOptions, build_panel
from lattica.sources.tabular import read_table


def test_old_layout_doubles_with_cluster(spark, tmp_path):
    path = str(tmp_path / "a.bin")
    with open(path, "wb") as f:
        f.write(struct.pack("<q4i", 3, 2, 1, 1, 0))
        f.write(np.array([1, 2, -1, 1, 0, 1, 0.5, -0.5, 2.0]).tobytes() + np.array([1, 1, 2, 10, 10, 99], "<i4").tobytes())
    df, spec = read_panel(spark, path, 2)
    assert spec == ModelSpec("y", ("x1", "x2"), (), ("fe1",), "cluster", None)
    assert [tuple(r) for r in df.collect()] == [(1.0, 1.0, 0.5, 1, 10), (2.0, 0.0, -0.5, 1, 10), (-1.0, 1.0, 2.0, 2, 99)]


def test_old_layout_floats_with_weights(spark, tmp_path):
    path = str(tmp_path / "b.bin")
    with open(path, "wb") as f:
        f.write(struct.pack("<q4ii", 2, 1, 2, 0, 1, 1) + np.array([0.25, 0.75, -1.5, 2.5], "<f4").tobytes())
        f.write(np.array([3, 4, 1, 1], "<i4").tobytes() + np.array([1.5, 2.5], "<f4").tobytes())
    df, spec = read_panel(spark, path)
    assert read_layout(path).precision == 1 and spec.weights == "weights"
    assert [tuple(r) for r in df.collect()] == [(0.25, -1.5, 3, 1, 1.5), (0.75, 2.5, 4, 1, 2.5)]


def test_damaged_file(tmp_path):
    path = tmp_path / "c.bin"
    path.write_bytes(struct.pack("<q6i", 100, 2, 0, 1, 0, 0, 0) + b"\0" * 50)
    with pytest.raises(ValueError):
        read_layout(str(path))


@pytest.mark.parametrize("precision", ["float64", "float32"])
def test_round_trip(spark, tmp_path, precision):
    rows = [("b", 1.5, 2.0, 7, 0.5), ("a", -1.0, 0.25, 9, 1.0), ("b", 3.0, 4.0, 7, 2.0), (None, 1.0, 1.0, 1, 1.0)]
    df = spark.createDataFrame(rows, "g string, y double, x double, c int, w double")
    path, spec = str(tmp_path / "p.bin"), ModelSpec("y", ("x",), (), ("g",), "c", "w")
    with pytest.raises(ValueError):
        write_panel(df, path, spec)
    info = write_panel(df, path, spec, precision, drop_missing_rows=True)
    assert info["n_obs"] == 3 and info["clustered"] and info["weights"]
    back, found = read_panel(spark, path, 2)
    assert found == spec
    got = sorted(tuple(r) for r in back.collect())
    assert got == [(-1.0, 0.25, 1, 2, 1.0), (1.5, 2.0, 2, 1, 0.5), (3.0, 4.0, 2, 1, 2.0)]
    assert read_panel(spark, path, columns=["g", "y"])[0].columns == ["g", "y"]


def test_synthetic_panel_recovers_coefficients(spark):
    panel = build_panel(spark, PanelOptions(workers=800, firms=12, betas=(0.4, -0.2), extra_vars=1, extra_coeffs=(0.7,), iv_vars=1)).cache()
    assert panel.count() == 6400
    r = fit(panel, "wage ~ tenure sick_shock extra_1, fe(worker firm time)")
    assert np.allclose(r.beta, [0.4, -0.2, 0.7], atol=0.06)
    again = build_panel(spark, PanelOptions(workers=800, firms=12, betas=(0.4, -0.2), extra_vars=1, extra_coeffs=(0.7,), iv_vars=1))
    assert again.repartition(3).exceptAll(panel).count() == 0


def test_config(tmp_path):
    path = tmp_path / "run.cfg"
    path.write_text("# all\ndata = d.bin # here\nformula = 'y ~ a#b, fe(f)'\nFE_TOL = 1e-9\nverbose = .TRUE.\nodd = 1\nno equals\nfe_names = a, b\n")
    c = load_config(str(path))
    assert (c.data, c.formula, c.fe_tol, c.verbose, c.fe_names) == ("d.bin", "y ~ a#b, fe(f)", 1e-9, True, ("a", "b"))
    assert strip_comment("a#b #c") == "a#b " and strip_comment("'x #y'") == "'x #y'"


def test_tables_and_command_line(spark, tmp_path, capsys):
    panel = build_panel(spark, PanelOptions(workers=60, firms=5)).toPandas()
    panel.to_csv(tmp_path / "t.csv", index=False)
    panel.to_pickle(tmp_path / "t.pkl")
    for name in ("t.csv", "t.pkl"):
        assert read_table(spark, str(tmp_path / name), columns=["wage", "firm", "wage"]).columns == ["wage", "firm"]
    out = str(tmp_path / "t.bin")
    main(["convert", str(tmp_path / "t.csv"), out, "--y", "wage", "--x", "tenure,sick_shock", "--fe", "worker,firm", "--summary"])
    assert '"n_obs": 480' in capsys.readouterr().out
    main(["estimate", "-d", out, "--cluster-fe", "1", "--save-fe", str(tmp_path / "fe"), "--fast"])
    assert "sick_shock" in capsys.readouterr().out
    lines = (tmp_path / "fe_fe2.csv").read_text().splitlines()
    assert lines[0] == "level_id,fe_value" and [x.split(",")[0] for x in lines[1:]] == ["1", "2", "3", "4", "5"]
    main(["synthesize", "-o", str(tmp_path / "s.bin"), "--workers", "20", "--firms", "3", "--iv-vars", "1", "--parquet-output", str(tmp_path / "s.parquet")])
    assert read_layout(str(tmp_path / "s.bin")).spec.z == ("iv_1",)
