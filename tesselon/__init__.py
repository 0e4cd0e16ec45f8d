"""Spark-native analytics over batches of images, the requests that bring them and the logs of the jobs that process them."""
