"""gridspark: spreadsheet-style calculation on Spark. Formula columns compile to Spark columns, windows and joins."""
