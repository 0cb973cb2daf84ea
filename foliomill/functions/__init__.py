"""Column functions: values, text extraction, model replies, formulas."""
