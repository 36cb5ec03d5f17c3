"""The command line on files."""

import glob

import pytest

from labelweave.__main__ import main, parser


def _lines(path):
    return [line.rstrip("\n").split("\t") for file in sorted(glob.glob(f"{path}/*.csv")) for line in open(file)]


def test_neten_pcc_and_report_on_files(spark, tmp_path):
    (tmp_path / "net.tsv").write_text("".join(f"n{k}\tn{(k + s) % 24}\t{1 + (k * s) % 5}\n" for k in range(24) for s in (1, 2, 5)))
    main(spark, ["neten", "--network", f"{tmp_path}/net.tsv", "--out", f"{tmp_path}/a"])
    assert all(len(x) == 3 and float(x[2]) > 0 for x in _lines(f"{tmp_path}/a/network"))
    (tmp_path / "m.tsv").write_text("id\tc1\tc2\tc3\nr1\t1\t2\t3\nr2\t2\t4\t6\nr3\t3\t2\t1\n")
    main(spark, ["pcc", "--matrix", f"{tmp_path}/m.tsv", "--out", f"{tmp_path}/b"])
    rows = _lines(f"{tmp_path}/b/correlation")
    found = {(r[0], r[1]): float(r[2]) for r in rows if r[0].startswith("r") and r[1].startswith("r") and r[0] != "row_a"}
    assert found["r1", "r2"] == pytest.approx(1) and found["r1", "r3"] == pytest.approx(-1)
    names = "id\ta\tb\tc\td\n"
    (tmp_path / "y.tsv").write_text(names + "g1\t1\t0\t0\t0\ng2\t0\t1\t0\t0\ng3\t0\t0\t1\t1\n")
    (tmp_path / "p.tsv").write_text(names + "g1\t0.9\t0.1\t0.2\t0.3\ng2\t0.2\t0.8\t0.1\t0.3\ng3\t0.1\t0.2\t0.7\t0.6\n")
    main(spark, ["report", "--truth", f"{tmp_path}/y.tsv", "--scores", f"{tmp_path}/p.tsv", "--out", f"{tmp_path}/c"])
    overall = _lines(f"{tmp_path}/c/overall")
    assert float(dict(zip(*overall, strict=True))["accuracy"]) == 1.0 and len(_lines(f"{tmp_path}/c/labels")) >= 5


def test_prop_on_files_and_flags(spark, tmp_path):
    (tmp_path / "net.tsv").write_text("".join(f"n{k}\tn{(k + 1) % 12}\t1\n" for k in range(12)))
    (tmp_path / "y.tsv").write_text("id\ta\tb\n" + "".join(f"n{k}\t{k % 2}\t{int(k < 4)}\n" for k in range(8)))
    (tmp_path / "genes.tsv").write_text("n9\nn10\n")
    shared = ["--networks", f"{tmp_path}/net.tsv", "--labels", f"{tmp_path}/y.tsv", "--genes", f"{tmp_path}/genes.tsv", "--out", f"{tmp_path}/d"]
    main(spark, ["prop", *shared])
    rows = _lines(f"{tmp_path}/d/features")
    assert {r[0] for r in rows} >= {"n9", "n10", "n0"} and rows[0][1:] == ["0000/a", "0000/b"]
    got = parser().parse_args(["tune", *shared, "--per-label", "--k", "0.1", "0.5", "2", "--verbose"])
    assert got.per_label and got.k == [0.1, 0.5, 2.0] and got.beta == 1.0
    with pytest.raises(SystemExit):
        parser().parse_args(["tune", "--out", "x"])


def test_prop_with_priors_on_files(spark, tmp_path):
    names = [f"n{k}" for k in range(12)]
    (tmp_path / "net.tsv").write_text("".join(f"n{k}\tn{(k + 1) % 12}\t1\n" for k in range(12)))
    (tmp_path / "y.tsv").write_text("id\ta\n" + "".join(f"n{k}\t{int(k in (0, 1, 2, 3, 6))}\n" for k in range(8)))
    (tmp_path / "genes.tsv").write_text("n9\n")
    near = [[1 + j % 3 if abs(k - j) in (1, 11) else 0 for j in range(12)] for k in range(12)]
    (tmp_path / "prior.tsv").write_text("\t".join(["id", *names]) + "\n" + "".join("\t".join([names[k], *map(str, row)]) + "\n" for k, row in enumerate(near)))
    files = ["--networks", f"{tmp_path}/net.tsv", "--labels", f"{tmp_path}/y.tsv", "--genes", f"{tmp_path}/genes.tsv", "--prior", f"{tmp_path}/prior.tsv", "--out", f"{tmp_path}/e"]
    main(spark, ["prop", *files])
    rows = _lines(f"{tmp_path}/e/features")
    assert {"n0", "n7", "n9"} <= {r[0] for r in rows} and rows[0][1:] == ["0000/a"]
    assert all(0 < float(r[1]) < 1 for r in rows if r[0] == "n0")


def test_the_last_line_of_the_last_file_counts(spark, tmp_path):
    from labelweave.sources import tsv

    (tmp_path / "net").mkdir()
    (tmp_path / "net" / "a.tsv").write_text("x\ty\t1\n")
    (tmp_path / "net" / "b.tsv").write_text("".join(f"n{k}\tm{k}\t1\n" for k in range(200)) + "x\ty\t5\ny\tx\t7\n")
    edges = {(r["src"], r["dst"]): r["w"] for r in tsv.read_network(spark, f"{tmp_path}/net").collect()}
    assert edges["x", "y"] == edges["y", "x"] == 7.0 and len(edges) == 402
