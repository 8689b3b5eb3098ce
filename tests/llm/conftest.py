import pytest

#: Columns that clash with names the operators use themselves.
CLASHING = ["kept", "score", "n_words", "key", "id", "copy", "spans", "size", "text_", "n_chars", "held_out"]


@pytest.fixture(scope="session")
def clashing(spark):
    from pyspark.sql import functions as F

    def add(df):
        return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING if c not in df.columns})

    return add
