"""Where the given tables are. A module of its own: each test folder has a ``conftest``."""

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
