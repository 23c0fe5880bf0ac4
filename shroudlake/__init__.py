"""shroudlake: finding, scoring, fusing and redacting personal data as Spark DataFrame operators."""
