import __spark_entry__


def test_entry_gives_rows(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1


def test_twins_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
