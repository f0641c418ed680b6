"""menuspark: restaurant-menu analytics and corpus preparation on Spark DataFrames."""
