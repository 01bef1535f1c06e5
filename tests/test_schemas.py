"""Validation while writing: all or nothing, one pass."""

import pytest
from pyspark.sql import functions as F

from flankline import schemas


def pair(**changes):
    row = dict(pair_id="p", analyte="CO", locus_id="l", hk_gene_accession="h", rr_gene_accession="r", intergenic_distance_nt=3, co_strand=True, hk_sensor_domains=["PAS"], hk_sensory_chemistries=[], rr_dna_binding_domains=[], pair_score=0.5)
    return tuple((row | changes).values())


def kinds(table):
    return ", ".join(f"`{c}` {t}" for c, t in schemas.TABLES[table].items())


def test_publish_and_read(spark, tmp_path):
    path = str(tmp_path / "pairs")
    good = spark.createDataFrame([pair(), pair(pair_id="q")], kinds("sensor_regulator_pairs"))
    schemas.publish(good, "sensor_regulator_pairs", path)
    assert schemas.read_table(spark, path, "sensor_regulator_pairs").count() == 2
    bad = spark.createDataFrame([pair(), pair(pair_id=None)], kinds("sensor_regulator_pairs"))
    with pytest.raises(schemas.SchemaError, match="pair_id is null': 1"):
        schemas.publish(bad, "sensor_regulator_pairs", path)
    assert spark.read.parquet(path).count() == 2  # what stood there stays
    with pytest.raises(schemas.SchemaError):
        schemas.publish(bad, "sensor_regulator_pairs", str(tmp_path / "never"))
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["pairs"]
    schemas.publish(good.limit(1), "sensor_regulator_pairs", path)
    assert spark.read.parquet(path).count() == 1


def test_one_pass(spark, tmp_path):
    """The rows are computed once for the write and the counts."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    good = spark.createDataFrame([pair()] * 50, kinds("sensor_regulator_pairs")).mapInArrow(counted, kinds("sensor_regulator_pairs"))
    schemas.publish(good, "sensor_regulator_pairs", str(tmp_path / "pairs"))
    assert seen.value == 50


@pytest.mark.parametrize("table", sorted(schemas.TABLES))
def test_every_table_conforms(spark, tmp_path, table):
    """An almost empty frame is filled with empty values, which only enumerated columns refuse."""
    some = {c: F.lit(v[0]) for c, v in schemas.VALUES.items() if c in schemas.TABLES[table]}
    some |= {"is_anchor": F.lit(True)} if table == "genes" else {}
    rows = schemas.conformed(spark.range(2).withColumns(some), table)
    schemas.publish(rows, table, str(tmp_path / table))
    assert [f.dataType.simpleString() for f in schemas.read_table(spark, str(tmp_path / table), table).schema] == list(schemas.TABLES[table].values())
    with pytest.raises(schemas.SchemaError, match="missing"):
        schemas.checked_columns(rows.drop(rows.columns[0]), table)
    with pytest.raises(schemas.SchemaError, match="unexpected"):
        schemas.checked_columns(rows.withColumn("more", F.lit(1)), table)


def test_rules_of_rows(spark):
    loci = schemas.conformed(spark.range(1).withColumns({"locus_confidence": F.lit("high"), "provenance_source": F.lit("refseq"), "phylum": F.lit("")}), "loci")
    with pytest.raises(schemas.SchemaError, match="without taxon.*without lineage"):
        schemas.validate(loci, "loci")
    tested = schemas.conformed(spark.range(1).withColumns({"feature_type": F.lit("archetype"), "q_value": F.lit(1.5)}), "enrichment")
    with pytest.raises(schemas.SchemaError, match="q_value is no share"):
        schemas.validate(tested, "enrichment")
