"""PySpark-native food, recipe and text analytics: plain DataFrame and Column functions."""
