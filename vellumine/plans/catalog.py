"""Named queries over the driver's tables and the SQL that gives the same rows."""

from __future__ import annotations

from vellumine.plans import lines, pdf, scalars

QUERIES = {**lines.QUERIES, **pdf.QUERIES, **scalars.QUERIES}
ORACLE = {**lines.ORACLE, **pdf.ORACLE, **scalars.ORACLE}
