import pytest

from spandrel.llm import common


@pytest.fixture(scope="session", autouse=True)
def no_collection_between_jobs():
    """Small tables leave few shuffle files behind, and a full collection before every table is what took the time."""
    kept, common.release = common.release, lambda spark: None
    yield
    common.release = kept
