"""The preprocessing run from FASTA files: what it writes, how it goes on, and what a change remakes."""

import json
import random

import pytest

from helixlake import __main__
from helixlake.config import Settings
from helixlake.operators import chunks, similarity
from helixlake.plans import preprocess

ALL = ["manifest", "near", "similarity", "exclusions", "components", "assignments", "final", "chunks", "checks"]
SETTINGS = Settings(chunk_size=200, minimum_tail=30)


@pytest.fixture
def inputs(tmp_path):
    """Genomes of two sources: copies, copies on the other strand, near copies, one sequence under two labels, and Ns."""
    rnd = random.Random(3)
    dna = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    turned = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    (tmp_path / "in").mkdir()
    told, base = [], [dna(rnd.randint(150, 900)) for _ in range(30)]
    texts = {f"g{i}": s for i, s in enumerate(base)}
    texts |= {"copy": base[0], "turned": turned(base[1]), "near": base[2][:100] + ("A" if base[2][100] != "A" else "C") + base[2][101:], "clash": base[3], "enn": "N" * 80 + dna(100)}
    for i, (name, s) in enumerate(texts.items()):
        source = "ARC" if i % 2 == 0 or name in ("copy", "clash") else "BAC"
        label = 1 if name == "clash" else 0
        file = f"{name}.fna"
        (tmp_path / "in" / file).write_text(f">{source}__{name}|c{name} text\n" + "\n".join(s[a : a + 60] for a in range(0, len(s), 60)) + "\n")
        told.append((source, file, label, "", "", "", "genome", "root|p|c|o|f|gen|sp"))
    table = tmp_path / "meta.tsv"
    table.write_text("\t".join(preprocess.METADATA) + "\n" + "".join("\t".join(map(str, x)) + "\n" for x in told))
    return tmp_path, texts


def test_run_goes_on_and_remakes_what_depends(spark, inputs, monkeypatch):
    top, texts = inputs
    run = lambda settings=SETTINGS: preprocess.run_folder(spark, f"file://{top}/in", f"file://{top}/meta.tsv", f"{top}/out", settings).made
    read = lambda n: spark.read.parquet(f"{top}/out/{n}")

    def lost(*_, **__):
        raise OSError("lost")

    whole = chunks.chunk_table
    monkeypatch.setattr(chunks, "chunk_table", lost)
    with pytest.raises(OSError):
        run()
    monkeypatch.setattr(chunks, "chunk_table", whole)
    assert run() == ["chunks", "checks"]  # the run that was stopped goes on
    assert run() == []
    final = {r.genome_id.split("__")[1]: r for r in read("final").collect()}
    assert set(final) == set(texts)
    assert final["enn"].exclusion_reason == "n_fraction_above_0.2" and {final[x].split for x in ("enn", "clash", "g3")} == {"quarantine"}
    for a, b in (("g0", "copy"), ("g1", "turned"), ("g2", "near")):
        assert final[a].split == final[b].split != "quarantine" and final[a].split_group == final[b].split_group
    assert len({r.split_group for r in final.values() if r.split != "quarantine"}) == 29  # 30 without the clash; the copies join others
    pieces = read("chunks").collect()
    for name, s in texts.items():
        own = sorted((r.chunk_start_0based, r.sequence) for r in pieces if r.genome_id.endswith(f"__{name}"))
        assert "".join(x for _, x in own) == ("" if final[name].split == "quarantine" else s)
    first = sorted(map(repr, pieces))
    assert read("checks").count() == 0
    assert {r.table for r in read("lineage").collect()} == set(ALL)
    # another seed remakes what follows from the split, and the old one gives the old rows
    assert run(Settings(chunk_size=200, minimum_tail=30, seed=5)) == ["assignments", "final", "chunks", "checks"]
    assert run()[0] == "assignments" and sorted(map(repr, read("chunks").collect())) == first
    # a table that is not what was written is made again
    spark.createDataFrame([("REC_x", "why")], "record_id string, reason string").write.mode("overwrite").parquet(f"{top}/out/exclusions")
    assert run() == ["exclusions"] and sorted(map(repr, read("chunks").collect())) == first
    # another label in the metadata remakes the manifest and all that follows from what has changed
    text = (top / "meta.tsv").read_text().replace("clash.fna\t1", "clash.fna\t0")
    (top / "meta.tsv").write_text(text)
    made = run()
    assert made[0] == "manifest" and "chunks" in made
    assert {r.genome_id for r in read("final").filter("split = 'quarantine'").collect()} == {"ARC__enn"}


def test_command_line(spark, inputs, capsys, monkeypatch):
    top, _ = inputs
    monkeypatch.setattr(spark, "stop", lambda: None)
    args = ["preprocess", f"file://{top}/in", f"file://{top}/meta.tsv", f"{top}/cli", "--settings", '{"chunk_size": 200, "minimum_tail": 30}']
    for want in (ALL, []):
        assert __main__.main(args) == 0
        assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["made"] == want


def test_a_repeated_record_id_is_an_error(spark, inputs):
    top, _ = inputs
    (top / "in" / "g0.fna").write_text(">ARC__g0|c1\nACGT\n>ARC__g0|c1\nGGGG\n")
    with pytest.raises(Exception, match="record id repeats"):
        preprocess.run_folder(spark, f"file://{top}/in", f"file://{top}/meta.tsv", f"{top}/out", SETTINGS)


def test_links_are_found_once_and_of_fragments_that_are_not_alone(spark, inputs, monkeypatch):
    top, _ = inputs
    given, whole = [], similarity.exact_edges
    monkeypatch.setattr(similarity, "exact_edges", lambda fragments, *more: given.append(fragments.count()) or whole(fragments, *more))
    preprocess.run_folder(spark, f"file://{top}/in", f"file://{top}/meta.tsv", f"{top}/out", SETTINGS)
    near = spark.read.parquet(f"{top}/out/near")
    assert given == [near.filter("copies > 1").count()] and 0 < given[0] < near.count() / 2
    assert {r.reason for r in spark.read.parquet(f"{top}/out/similarity").collect()} == {"exact_fragment", "near_fragment"}
    assert {r.reason for r in spark.read.parquet(f"{top}/out/exclusions").collect()} == {"cross_label_exact_fragment"}
