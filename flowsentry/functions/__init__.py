"""Column expressions: nothing here touches data by itself."""
