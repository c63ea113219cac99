"""Registered queries; importing a module of this package registers its queries."""

from collegium.plans import attendance, catalogue, changes, class_timetables, declarations, display, documents, exam_timetables, files, folds, grading, imports, invariants, lookups, notices, results, schemes, syllabi, texts, upserts  # noqa: F401
