import pytest

from keelson.engine import Engine
from keelson.sources.store import Options


@pytest.fixture
def make(spark, tmp_path):
    """Engines over the same folder: make() opens another."""
    return lambda **options: Engine(spark, str(tmp_path / "db"), Options(**options))


@pytest.fixture
def db(make):
    return make()
