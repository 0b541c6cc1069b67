"""riskspark: defect-risk analytics over source text, commit history and coverage, on PySpark."""
