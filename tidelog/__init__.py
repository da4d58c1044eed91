"""A log analytics engine on Spark: pipe queries over schema-flexible records, compiled to DataFrame plans."""
