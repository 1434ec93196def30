"""The modules whose queries are registered."""

from sigtrail.plans import assessments, binaries, compositions, crosschecks, custom, detection, discoveries, nested, relational, relations, reports, reviews, sourcecode, sources

MODULES = [detection, relational, relations, custom, reports, reviews, assessments, sourcecode, crosschecks, discoveries, nested, sources, compositions, binaries]
