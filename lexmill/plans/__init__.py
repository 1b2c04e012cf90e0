"""The query catalogue: each plan with the SQL it is held against."""
