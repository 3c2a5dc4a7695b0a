import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from copperline.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return build_session(cores="8", partitions=4, memory="6g")


def fixed(*code: str, seq: bool = True) -> str:
    """Code lines as numbered lines of the fixed format."""
    return "\n".join(f"{(i + 1) * 10:06d} {c}" if seq else f"       {c}" for i, c in enumerate(code))


@pytest.fixture(scope="session")
def make(spark):
    """Sources from name to text."""
    def build(**programs: str):
        rows = [(f"/src/{n}.cbl", f"{n}.cbl", t) for n, t in programs.items()]
        return spark.createDataFrame(rows, "path string, file_name string, content string")

    return build
