"""All queries of the library by name."""

from quillmill.plans import clinical, coding, documents, events, learning, records, tagging  # noqa: F401  they register their queries
from quillmill.plans.registry import QUERIES  # noqa: F401
