"""All registered queries. Importing the submodules fills the registry."""

from martlet.suite.registry import ORACLE, QUERIES, register  # noqa: F401
from martlet.suite import sales, insight, rules, quality, text  # noqa: F401,E402
