import duckdb
import pytest


@pytest.fixture()
def write(spark, tmp_path):
    """Write tables (name=DataFrame) as a scale factor's folder and give its path."""

    def put(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return put


@pytest.fixture()
def sql(tmp_path):
    """Run SQL over the folder's tables: a sorted list of rows by the names of the columns."""

    def run(text):
        db = duckdb.connect()
        for p in tmp_path.glob("*.parquet"):
            db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}/*.parquet'")
        out = db.execute(text)
        names = [d[0] for d in out.description]
        return sorted((tuple(v for _, v in sorted(zip(names, r, strict=True))) for r in out.fetchall()), key=str)

    return run
