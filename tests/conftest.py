import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from honestpick.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", shuffle_partitions=4, memory="4g")
    yield s
    s.stop()


ARM_ROWS = [
    ("exploratory", 1, "single", 10, 2, "true", "false"),
    ("exploratory", 1, "tiny", 1, 1, "true", "false"),
    ("exploratory", 2, "tiny", 20, 1, "false", "false"),
    ("holdout", 20, "tie", 10, 5, "false", "false"),
    ("holdout", 10, "tie", 8, 4, "true", "true"),
    ("confirmatory", 1, "regular", 12, 3, "false", "false"),
    ("confirmatory", 2, "regular", 12, 4, "true", "false"),
]


@pytest.fixture(scope="session")
def raw_arms(spark):
    return spark.createDataFrame(ARM_ROWS, (
        "split string, source_row_id bigint, test_id string, impressions bigint, clicks bigint, "
        "first_place string, winner string"))


@pytest.fixture(scope="session")
def arms(raw_arms):
    from honestpick.operators import prep as P
    return P.eligible_tests(P.prepare_arms(raw_arms), 2, 2)


@pytest.fixture(scope="session")
def hand_rows(spark):
    """Arms a = (0, 2) and b = (1, 3) by position."""
    return spark.createDataFrame([("t", 0, 0, 0.0), ("t", 0, 1, 2.0), ("t", 1, 2, 1.0),
                                  ("t", 1, 3, 3.0)],
                                 "test_id string, arm int, row_id bigint, y double")


@pytest.fixture(scope="session")
def noisy_rows(spark):
    """Three arms of 40 rows with close means."""
    import numpy as np
    rng = np.random.default_rng(7)
    data = [("t", a, a * 1000 + i, float(rng.normal(a * 0.1, 1.0)))
            for a in range(3) for i in range(40)]
    return spark.createDataFrame(data, "test_id string, arm int, row_id bigint, y double")
