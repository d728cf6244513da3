from datetime import datetime

import pytest

from daytide.schema import EVENT_SCHEMA
from daytide.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "daytide-tests", "4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_events(spark):
    """Event frame from dicts; unnamed columns get ordinary values."""
    usual = {
        "user_id": "u",
        "event_id": "1",
        "bullet_id": None,
        "created_at": datetime(2026, 1, 5, 4),
        "bet": 1.0,
        "payout": 0.0,
        "profit": None,
        "curr_balance": 10.0,
        "op_code": "A01",
        "currency_type": "CNY",
        "game_id": "FM01",
    }

    def make(rows):
        full = [usual | r for r in rows]
        return spark.createDataFrame(
            [tuple(r[c] for c in EVENT_SCHEMA.names) for r in full], EVENT_SCHEMA
        )

    return make
