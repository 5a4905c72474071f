import pytest


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    """Session whose checkpoint folder is a fresh one of this run."""
    from evalloom.session import local_session

    session = local_session("8")
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    return session


@pytest.fixture(scope="session")
def documents(spark):
    """Build a documents table: tuples of (doc_id, text[, source[, lang]])."""

    def build(*rows):
        padded = [(*r, *([None] * (4 - len(r)))) for r in rows]
        return spark.createDataFrame(
            [(i, t, lang, source, None if t is None else len(t)) for i, t, source, lang in padded],
            "doc_id long, text string, lang string, source string, n_chars long",
        )

    return build
