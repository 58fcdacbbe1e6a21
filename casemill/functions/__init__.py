"""Column functions: cleaning, classification and display of case fields."""
