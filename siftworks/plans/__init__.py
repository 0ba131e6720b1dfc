"""Named queries: importing the package registers all of them in catalog.QUERIES."""

from siftworks.plans import catalog, jobs, more

__all__ = ["catalog", "jobs", "more"]
