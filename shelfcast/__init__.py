"""shelfcast: retail sales analytics as PySpark DataFrame jobs.

Every job takes a canonical ``sales`` DataFrame (see ``shelfcast.schema``) plus
plain parameters and returns a DataFrame. Nothing is collected to the driver.
"""

__version__ = "0.1.0"
