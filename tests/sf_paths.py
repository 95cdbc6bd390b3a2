"""Table folders of the tests. Not in ``conftest.py``: a folder below may have a
``conftest`` of its own, and only one module can have that name."""

import os

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = os.environ.get("KPIFORGE_TEST_SF", SF_SMALL)
