"""pagewright: paginated-document analytics expressed as Spark DataFrame plans."""
