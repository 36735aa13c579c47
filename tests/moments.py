"""Times for hand-made rows."""

import datetime


def at(text: str) -> datetime.datetime:
    return datetime.datetime.fromisoformat(text).replace(tzinfo=datetime.timezone.utc)
