"""Where the tests find their tables. A module of its own: every folder of
tests has a ``conftest``, and only one module of that name can be imported."""

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"
