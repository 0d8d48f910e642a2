"""What several tests share."""

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def same_rows(spark_frame, relation):
    """Compares a DataFrame with a DuckDB result: column names, and rows in any order, floats to six digits."""

    def rows(columns, data):
        order = sorted(range(len(columns)), key=lambda k: columns[k])
        text = lambda v: "NULL" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)
        return sorted(tuple(text(r[k]) for k in order) for r in data)

    assert sorted(spark_frame.columns) == sorted(relation.columns)
    got, wanted = rows(spark_frame.columns, [tuple(r) for r in spark_frame.collect()]), rows(relation.columns, relation.fetchall())
    assert got == wanted
