"""Where the test data lies. A plain module, so that no test imports from a conftest."""

from __future__ import annotations

DATA = "/root/testdata"
