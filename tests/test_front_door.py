import json

import pytest

from gatehouse import cli
from gatehouse.operators import leakage
from gatehouse.plans import registry
from gatehouse.sources import readers

CLEAN = "ACGTTGCATCAGGATCTACGACTGATCGTACTTGACCATGCAAGTCTGAGCATTAGCCTA"


def test_fasta_and_qualify(spark, tmp_path):
    f = tmp_path / "a.fasta"
    f.write_text(f">one first\n{CLEAN[:30]}\n{CLEAN[30:]}\n>\n{'AT' * 30}\n")
    got = {r.name: r for r in registry.qualify(spark, str(f), "dna").items.collect()}
    assert got["one"].ok and got["one"].seq == CLEAN and got["seq1"].fired[0] == "GC_OUT_OF_BAND"
    with pytest.raises(registry.QualifyError):
        registry.qualify(spark, str(f))
    with pytest.raises(registry.QualifyError):
        registry.qualify(spark, CLEAN, "no such")


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["list"]) == 0
    assert cli.main(["qualify", CLEAN, "-m", "dna", "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["ok"]
    assert cli.main(["qualify", "AT" * 30, "-m", "dna"], spark) == 1
    assert cli.main(["qualify", CLEAN], spark) == 2
    assert cli.main(["repair", "A" * 40 + CLEAN, "--json"]) == 0
    screen = tmp_path / "s.csv"
    screen.write_text("Gene,Residual,pval,cells\nA,0.9,0.5,100\nB,0.1,0.5,100\nC,NA,0.01,10\nnon-targeting,0.1,0.5,9\n")
    capsys.readouterr()
    assert cli.main(["audit", "single-cell", "--input", str(screen)], spark) == 0
    report = json.loads(capsys.readouterr().out)
    assert (report["n"], report["hits"], report["unsupported"]) == (3, 1, 1)


def test_screen_tables(spark, tmp_path):
    t = tmp_path / "c.tsv"
    t.write_text("sgRNA\tGene\tx.initial\tx.final\ng1\tabc\t10\t3\ng2\tabc\tbad\t3\n")
    assert [tuple(r) for r in readers.counts(spark, str(t)).orderBy("sample").collect()] == [("g1", "ABC", "x.final", "final", 3), ("g1", "ABC", "x.initial", "initial", 10)]
    bad = tmp_path / "b.csv"
    bad.write_text("x,y\n1,2\n")
    with pytest.raises(readers.SourceError):
        readers.user_screen(spark, str(bad))


def _line(n, name, res, chain, num, x, y, z, element, record="ATOM"):
    return f"{record:<6}{n:>5} {name:<4} {res:>3} {chain}{num:>4}    {x:8.3f}{y:8.3f}{z:8.3f}  1.00  0.00          {element:>2}"


def test_structures(spark, tmp_path):
    lines = [_line(i, "CA", "ALA", "A", i, 4.0 * i, 0, 0, "C") for i in range(6)] + [_line(20 + i, "CA", "GLY", "B", i, 4.0 * i, 0.5, 0, "C") for i in range(5)]
    lines += [_line(40, "H1", "ALA", "A", 9, 0, 0, 0, "H"), _line(41, "C1", "LIG", "C", 1, 0, 3.5, 0, "C", "HETATM"), _line(42, "O", "HOH", "W", 1, 0, 1, 0, "O", "HETATM")]
    p = tmp_path / "x.pdb"
    p.write_text("\n".join(lines) + "\nATOM  bad line\n")
    atoms = readers.pdb(spark, str(p))
    assert atoms.count() == 13
    v = registry.qualify(spark, str(p), "complex").items.first()
    assert v.framed and v.n_clash == 5 and "SEVERE_INTERFACE_CLASH" in v.fired and abs(v.min_dist - 0.5) < 1e-6
    w = registry.qualify(spark, str(p), "cofold", ligand_resname="LIG").items.first()
    assert w.framed and abs(w.min_dist - 2.5) < 1e-6 and 0 < w.overlap_frac < 0.5  # all but the named residue counts as protein
    cif = tmp_path / "x.cif"
    head = "\n".join(f"_atom_site.{c}" for c in "group_PDB id type_symbol label_atom_id label_comp_id auth_asym_id auth_seq_id Cartn_x Cartn_y Cartn_z".split())
    cif.write_text(f"data_x\nloop_\n{head}\nATOM 1 C CA ALA A 1 0.0 1.0 2.0\nATOM 2 H HA ALA A 1 0 0 0\nHETATM 3 O O1 LIG B 7 1 1 1\n#\n")
    got = readers.cif(spark, str(cif)).orderBy("atom").collect()
    assert [(r.element, r.chain, r.resnum, r.is_hetero) for r in got] == [("C", "A", 1, False), ("O", "B", 7, True)]


def test_splits(spark):
    df = spark.createDataFrame([(i, ["a", "b", "", None, "c"][i % 5]) for i in range(100)], "id int, g string")
    s = leakage.group_split(df, "g", 0.3, "x")
    assert s.count() == 100 and s.select("g", "split").distinct().count() == 5
    assert s.where("g = '' or g is null").select("split").distinct().count() == 1
    r = leakage.random_split(df, "id", 0.25, "x")
    assert r.where("split = 'train'").count() == 75
