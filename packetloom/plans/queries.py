"""All driver queries: importing the modules registers them."""

from . import finding_queries, flow_queries, record_queries, report_queries  # noqa: F401
from .catalog import ORACLE_SQL, QUERIES  # noqa: F401
