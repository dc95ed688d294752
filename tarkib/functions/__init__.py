"""Column expressions and Arrow UDFs over text: normal forms, folds, measures, readings, alignment, meter."""
