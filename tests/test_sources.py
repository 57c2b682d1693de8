import gzip

from pyspark.sql import functions as F

from liaison.sources import readers as R


def test_profile_matrix(spark, tmp_path):
    with gzip.open(tmp_path / "m.csv.gz", "wt") as f:
        f.write("id,HP:1,HP:2,other\nA,1,0,1\nB,1.0,1.0,0\n")
    assert {tuple(r) for r in R.profile_matrix(spark, str(tmp_path / "m.csv.gz")).collect()} == {("A", "HP:1"), ("B", "HP:1"), ("B", "HP:2")}


def test_ontology_lines(spark, tmp_path):
    (tmp_path / "o.csv").write_text("hp_id;name;parents\nHP:0000002;Height;['HP:0000001', 'HP:0000003']\nHP:0000001;All;\n")
    rows = {r["term"]: (r["name"], r["parents"]) for r in R.ontology_lines(spark, str(tmp_path / "o.csv")).collect()}
    assert rows == {"HP:0000002": ("Height", ["HP:0000001", "HP:0000003"]), "HP:0000001": ("All", [])}


def test_annotations(spark, tmp_path):
    (tmp_path / "a.hpoa").write_text("#one\n#two\ndatabase_id\tdisease_name\thpo_id\nOMIM:1\t Some-Thing  Else\tHP:0000001\n")
    assert tuple(R.annotations(spark, str(tmp_path / "a.hpoa")).first()) == ("OMIM:1", "some thing else", "HP:0000001")


def test_cross_references(spark, tmp_path):
    ref = "<ExternalReference><Source>{}</Source><Reference>{}</Reference><DisorderMappingRelation><Name>E</Name></DisorderMappingRelation></ExternalReference>"
    body = f"<R><Disorder><OrphaCode>7</OrphaCode><ExternalReferenceList>{ref.format('OMIM', 12)}{ref.format('ICD', 3)}</ExternalReferenceList></Disorder></R>"
    (tmp_path / "x.xml").write_text(body)
    assert [tuple(r) for r in R.cross_references(spark, str(tmp_path / "x.xml")).collect()] == [("ORPHA:7", "OMIM:12", "E")]


def test_text_embeddings_and_lists(spark, tmp_path):
    (tmp_path / "e.txt").write_text("2 3\na 1 2 3.5\nb x 2 3\n")
    rows = [tuple(r) for r in R.text_embeddings(spark, str(tmp_path / "e.txt")).collect()]
    assert ("a", [1.0, 2.0, 3.5]) in rows and "b" not in {r[0] for r in rows}
    assert spark.createDataFrame([("a|b",), (None,)], "x string").select(R.pipe_list("x")).collect()[1][0] == []


def test_round_trip_and_cache(spark, tmp_path):
    rows = spark.createDataFrame([("t", ["a", "b"], 0.5)], "target string, sources array<string>, q double")
    R.write_results(rows, str(tmp_path / "out"))
    assert tuple(R.results(spark, str(tmp_path / "out")).first()) == ("t", "a|b", 0.5)
    calls = []

    def build():
        calls.append(1)
        return spark.range(3).select(F.col("id"))

    for _ in range(2):
        assert R.cached(spark, str(tmp_path / "cache"), {"k": 1}, build).count() == 3
    assert len(calls) == 1


def test_names_links_costs_and_metrics(spark, tmp_path):
    (tmp_path / "n.csv").write_text("hp_id;name;x\nHP:1;b;\nHP:1;a;\n;c;\nHP:2;;\n")
    assert {tuple(r) for r in R.names(spark, str(tmp_path / "n.csv")).collect()} == {("HP:1", "a"), ("HP:2", None)}
    (tmp_path / "l.txt").write_text("protein1 protein2 combined_score\na b 700\nb c 699\n")
    assert R.protein_links(spark, str(tmp_path / "l.txt")).count() == 2
    assert [tuple(r) for r in R.protein_links(spark, str(tmp_path / "l.txt"), least=700).collect()] == [("a", "b", 700)]
    (tmp_path / "g.tsv").write_text("gene\tdisease\tsource\nG\tD\tS\n")
    assert [tuple(r) for r in R.gene_associations(spark, str(tmp_path / "g.tsv")).collect()] == [("G", "D")]
    (tmp_path / "i.tsv").write_text("#string_protein_id\tpreferred_name\tprotein_size\tannotation\np\tg\t7\tx\n")
    assert [tuple(r) for r in R.protein_info(spark, str(tmp_path / "i.tsv")).collect()] == [("p", "g", "x")]
    (tmp_path / "c.csv").write_text(",0,1\n0,0.5,1\n1,,2.25\n")
    assert {tuple(r) for r in R.cost_matrix(spark, str(tmp_path / "c.csv")).collect()} == {(0, 0, 0.5), (0, 1, 1.0), (1, 0, None), (1, 1, 2.25)}
    (tmp_path / "m.json").write_text('{"auc": 0.5,\n "name": "x"}')
    assert {tuple(r) for r in R.metric_rows(spark, str(tmp_path / "m.json")).collect()} == {("m.json", "auc", 0.5), ("m.json", "name", None)}


def test_embeddings_are_written_as_they_are_read(spark, tmp_path):
    rows = [("a", [0.1, -2e-9]), ("b", [3.0, 4.0])]
    R.write_embeddings(spark.createDataFrame(rows, "term string, vec array<double>"), str(tmp_path / "e"))
    assert sorted(map(tuple, R.text_embeddings(spark, str(tmp_path / "e")).collect())) == rows


def test_run_directories_are_numbered(spark, tmp_path):
    base = str(tmp_path / "logs")
    assert [R.run_directory(spark, base) for _ in range(2)] == [f"{base}/0", f"{base}/1"]
    (tmp_path / "logs" / "7").mkdir()
    (tmp_path / "logs" / "notes").mkdir()
    assert R.run_directory(spark, base) == f"{base}/8" and (tmp_path / "logs" / "8").is_dir()
    (tmp_path / "none").mkdir()
    assert R.run_directory(spark, str(tmp_path / "none")) == f"{tmp_path}/none/1"
