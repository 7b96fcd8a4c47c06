import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SYLLABLES = "an the in er on re ti st en at nd or ha ed is it ou ar".split()


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"


@pytest.fixture
def rng():
    return random.Random(7)


@pytest.fixture
def words(rng):
    """``n`` words from a small alphabet of syllables."""

    def make(n):
        return ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n)]

    return make
