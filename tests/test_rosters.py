"""Rosters on small texts, and CSV tables there and back."""

from pyspark.sql import functions as F

from interlace.functions import rosters
from interlace.sources import files


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def test_readings(spark):
    t = F.col("t")
    assert one(spark, rosters.close_gaps(t), t="Ban que de Crédit, SOCIÉ TÉ et de Ia Com pagnie de 1'Est") == "Banque de Crédit, SOCIÉTÉ et de la Compagnie de l'Est"
    assert one(spark, rosters.organisation(t), t=" de la  Société du Canal, Port-Saïd.") == "Société du Canal"
    assert one(spark, rosters.running_head(t), t="Annuaire") is False
    for name, role, firm in (("Tramways", None, True), ("Cour des comptes", None, False), ("Union", "member", False), ("Union", "director", True), ("union", None, False)):
        assert one(spark, rosters.is_firm(F.col("t"), F.col("r")), t=name, r=role) is firm
    assert one(spark, rosters.city(t), t="nowhere") is None


def test_boards_of_nothing(spark):
    blocks = spark.createDataFrame([(1, None), (2, ""), (3, "Censeur :\nCapital : 5")], "k long, t string")
    assert rosters.board(blocks, "k", "t", (("auditor", "censeurs?"),), ("capital",)).count() == 0


def test_csv(spark, tmp_path):
    rows = [(1, 'a "quoted", name', 2.5), (2, "two\nlines", None), (3, None, 0.0)]
    df = spark.createDataFrame(rows, "id long, name string, share double")
    manifest = files.write_tables({"one": df, "none": df.limit(0)}, f"{tmp_path}/out")
    assert {tuple(r) for r in manifest.collect()} == {("one", 3, "id;name;share"), ("none", 0, "id;name;share")}
    back = files.read_csv(spark, f"{tmp_path}/out/one", "id long, name string, share double")
    assert sorted(tuple(r) for r in back.collect()) == rows
