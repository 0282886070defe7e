"""Where the driver's tables are; a module of its own name, as ``conftest`` exists in both test folders."""

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"
