from __future__ import annotations

import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

from docpipe.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


# Started at import, because test modules name columns when they are collected.
_SESSION = local_session(8, shuffle_partitions=4)


@pytest.fixture(scope="session")
def spark():
    return _SESSION
