import pyarrow.parquet as pq
import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

DOC_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                           T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs_rows():
    """(doc_id, text, source) of the small documents table."""
    t = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    return [(r["doc_id"], r["text"], r["source"]) for r in t]


@pytest.fixture()
def make_docs(spark):
    """documents rows from (doc_id, text) or (doc_id, text, source) tuples."""
    def make(rows, parts=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOC_SCHEMA).repartition(parts)
    return make


@pytest.fixture()
def write_sf(tmp_path):
    """A folder with documents.parquet (and other tables) for the registered queries."""
    def write(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)
    return write
