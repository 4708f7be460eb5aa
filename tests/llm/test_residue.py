"""Residue and its look-alikes, written apart from the test tables.

The sets were written one after the other, each after the grammars had been mended for
the one before, and measured before any mending for it: of the first 58 of 66 residues
were found and one of 50 ordinary sentences was taken for residue, of the second 30 of
40 and none of 30, of the third 25 of 28 and none of 18.
"""

from lexiloom.llm.residue import residue

RESIDUE_1 = [
    "Page not found",
    "Internal Server Error",
    "This site can't be reached",
    "An error occurred while processing your request.",
    "Turn JavaScript on to continue.",
    "Bạn chưa bật JavaScript.",
    "Hello [Your Name], thanks for writing to us.",
    "{{#if user}}Welcome back{{/if}}",
    "Name: {{ user.name | upper | trim }}",
    "{% if x == 1 %}shown{% endif %}",
    "Cras mattis consectetur purus sit amet fermentum.",
    "The service is temporarily unavailable. Please try again later.",
    "503 Service Temporarily Unavailable",
    "We're sorry, but something went wrong on our end.",
    "You need to enable JavaScript to run this app.",
    "This page requires JavaScript. Please enable it in your browser.",
    "Your session has expired, please sign in again.",
    "Access to this resource is forbidden.",
    "Unable to connect to the database.",
    "Fatal error: Call to undefined function foo() in /var/www/index.php on line 3",
    "Warning: mysqli_connect(): Connection refused",
    "NullPointerException: null at com.app.Main(Main.java:12)",
    "Dear Mr. [Last Name], your order has been shipped.",
    "Hi ${customer.firstName}, your total is ${order.total}.",
    "<p>Hello <?php echo $name; ?></p>",
    "Donec ullamcorper nulla non metus auctor fringilla.",
    "Your text goes here.",
    "Insert description here",
    "Bài viết này đang được biên soạn.",
    "Nội dung đang được cập nhật, mời bạn quay lại sau.",
    "Hệ thống đang bảo trì, vui lòng quay lại sau.",
    "Không tìm thấy trang bạn yêu cầu.",
    "Đã xảy ra lỗi khi tải dữ liệu.",
    "Vui lòng bật JavaScript để sử dụng trang web này.",
    "Trình duyệt của bạn không hỗ trợ JavaScript.",
    "Bạn cần đăng nhập để xem nội dung này.",
    "Kết nối đến máy chủ bị gián đoạn.",
    "Liên kết này đã hết hạn.",
    "asdf jkl; asdf jkl; asdfjkl;",
    "test test test test test",
    "TODO: write this section",
    "Coming soon...",
    "Sorry, this page isn't available.",
    "The link you followed may be broken, or the page may have been removed.",
    "The requested URL /foo/bar was not found on this server.",
    "Connection timed out.",
    "Please enable cookies to continue.",
    "Checking your browser before accessing the website.",
    "Please verify you are a human",
    "%FIRST_NAME%, welcome to our shop",
    "Customer: <<Client Name>>",
    "Dear @@name@@,",
    "No content available",
    "Failed to load resource: the server responded with a status of 404",
    "We could not find the page you were looking for.",
    "JavaScript is disabled in your browser.",
    "Product 1\nDescription of product 1\nProduct 2\nDescription of product 2",
    "ERROR 1064 (42000): You have an error in your SQL syntax",
    "[Insert company name here] is a leader in its field.",
    "Chào {ten_khach_hang}, đơn hàng của bạn đã được gửi.",
    "This is placeholder text that will be replaced later.",
    "To be announced.",
    "502 Bad Gateway nginx",
    "An unexpected error has occurred.",
    "Too many requests. Slow down.",
    "You do not have permission to access this page.",
]
ORDINARY_1 = [
    "The bridge was closed because an error in the plan had been found too late.",
    "Sorry, I could not open the jar.",
    "The page of the book was torn.",
    "Please turn on the lamp in the kitchen.",
    "He failed to find the road in the fog.",
    "She did not have permission to leave the school.",
    "The server brought us two plates of soup.",
    "The word server (noun) means a person who serves.",
    "JavaScript is a programming language created in 1995.",
    "Many developers learn JavaScript before they learn Python.",
    "To write a template, put the name in double braces, such as {{name}}, and the engine fills it in when the page is shown to a reader.",
    "A lorem is not a word of English, but printers know it well.",
    "The message \"404 Not Found\" tells the reader that the address is wrong.",
    "\"Access denied\" thường được dịch là \"từ chối truy cập\".",
    "Anh ấy không tìm thấy chìa khóa trong túi áo.",
    "Trang sách này bị rách từ lâu.",
    "Không ai biết hệ thống đường ống dài bao nhiêu.",
    "Bài thơ này được viết vào năm 1945.",
    "The road is under construction, so take the ferry.",
    "His connection with the family was lost after the war.",
    "They refused the request of the old farmer.",
    "The list [see page 4] was long.",
    "He said nothing [laughs] and left.",
    "Mọi người đang chờ tàu ở ga.",
    "The number 404 bus goes to the market.",
    "500 people came to the party.",
    "The doctor was unable to see patients on Monday.",
    "The house is for sale; the price is to be discussed with the owner.",
    "Here we grow apples and onions.",
    "The sample of water was sent to the laboratory.",
    "He enabled his brother to study abroad.",
    "Please log the hours that you work.",
    "The actor read the script twice before he agreed.",
    "The cookies are in the tin on the shelf.",
    "error (danh từ): lỗi, sai sót",
    "placeholder (noun): a word that stands for another.",
    "The storm interrupted the music for an hour.",
    "Chúng tôi không thể mở cánh cửa gỗ cũ.",
    "Hiện nay nhiều người trẻ học tiếng Anh.",
    "Xin lỗi, tôi đến muộn.",
    "Rất tiếc, chúng tôi đã bán hết bánh mì.",
    "Something went wrong with the cake.",
    "The site of the old castle is on the hill.",
    "The host was not pleased with the guests.",
    "The gate was blocked by snow.",
    "If the file breaks, sharpen it with a stone.",
    "No data were collected during the first winter of the study.",
    "The application of heat softens the wax.",
    "The network of canals is no longer used.",
    "Our account of the journey is not complete.",
]
RESIDUE_2 = [
    "Error: page does not exist.",
    "The server encountered an internal error and was unable to complete your request.",
    "We can't seem to find the page you're looking for.",
    "Your connection is not private",
    "Service unavailable",
    "Sorry, your request could not be completed at this time.",
    "The database is currently offline.",
    "JavaScript must be enabled in order to use this site.",
    "Our site works best with JavaScript. Switch JavaScript on and reload.",
    "For full functionality of this site it is necessary to enable JavaScript.",
    "Looks like you have JavaScript disabled.",
    "Website này yêu cầu JavaScript để hoạt động.",
    "JavaScript đang bị tắt trong trình duyệt của bạn.",
    "Trang bạn đang tìm không tồn tại.",
    "Máy chủ gặp sự cố, xin thử lại sau.",
    "Không thể kết nối tới máy chủ.",
    "Đường dẫn này không còn hoạt động.",
    "Bạn không được phép truy cập trang này.",
    "Phiên đăng nhập đã hết hạn.",
    "Mục này chưa có nội dung.",
    "Thank you, {{ first_name|title }}!",
    "{% for item in items %}row{% endfor %}",
    "{{> header}} body {{/each}}",
    "Best regards, [YOUR NAME]",
    "Order no. #{order_id} for %(customer)s",
    "Your name: <insert name here>",
    "Vestibulum ante ipsum primis in faucibus orci luctus.",
    "Pellentesque habitant morbi tristique senectus et netus.",
    "Aenean massa, cum sociis natoque penatibus et magnis.",
    "Add your text here.",
    "This section is coming soon.",
    "Description to be added.",
    "Lorem ipsum",
    "java.lang.IllegalStateException: stream closed",
    "Uncaught TypeError: x is undefined",
    "Notice: Undefined index: id in page.php on line 12",
    "bla bla bla bla bla bla",
    "[Company Address], [City]",
    "403 Forbidden",
    "Request timed out",
]
ORDINARY_2 = [
    "She could not find her shoes under the bed.",
    "The captain denied that the ship had been damaged.",
    "Nobody knows where the old server of the inn went.",
    "The results of the election were shown on the wall.",
    "The page carried the sword of the king.",
    "They turned the lights on before sunset.",
    "The script was written by two monks.",
    "The author explains how a browser runs JavaScript.",
    "In a template, ${name} is written where the name of the reader goes, as the manual explains at length.",
    "\"Page not found\" means that the address has changed.",
    "The Latin words dolor and amor are in the dictionary.",
    "Thành phố đang xây dựng một cây cầu mới.",
    "Cô ấy chưa có con.",
    "Hệ thống tưới nước của làng rất cũ.",
    "Chúng tôi từ chối lời mời của họ.",
    "Phần này của bài hát rất khó hát.",
    "Máy chủ (danh từ): máy tính phục vụ các máy khác.",
    "The train was temporarily stopped by snow.",
    "An error of two degrees is not much.",
    "A list of sample questions is found in the last chapter.",
    "The translation of this poem is not easy.",
    "Wait here until the bell rings.",
    "Put the box here and go.",
    "The account of the war was written later.",
    "The document [1745] is kept in the museum.",
    "The room was empty.",
    "The dog was lost.",
    "Do not open the door.",
    "Access to the valley is easy in summer.",
    "He was not allowed to see the sea.",
]
RESIDUE_3 = [
    "Sorry! That page has been moved or deleted.",
    "Error establishing a database connection",
    "Hmm. We're having trouble finding that site.",
    "The server at example.org took too long to respond.",
    "Please activate JavaScript in your browser settings.",
    "You must have JavaScript enabled to view comments.",
    "Trang này đang được bảo trì.",
    "Xin lỗi, đã xảy ra lỗi hệ thống.",
    "Không tải được nội dung, hãy thử lại.",
    "Hãy kích hoạt JavaScript rồi tải lại trang.",
    "Dear [First Name], welcome.",
    "Hi {{name}}!",
    "Total: ${amount}",
    "Nulla vitae elit libero, a pharetra augue.",
    "Sed posuere consectetur est at lobortis.",
    "Article text to be added later.",
    "[TODO] add picture",
    "FIXME: check this date",
    "404: Not Found",
    "HTTP 500",
    "Gateway timeout",
    "Access denied.",
    "Enter your text here",
    "Nội dung mẫu.",
    "This content is not available in your region.",
    "Line 3: SQLSTATE[42S02]: Base table not found",
    "Your account has been suspended.",
    "jfkd jfkdls jfkdsl fjdksl jfkdls fjdkls",
]
ORDINARY_3 = [
    "The girl who sold apples could not find the list.",
    "It is forbidden to fish in this lake.",
    "The page turned red.",
    "He is not found at home on Sundays.",
    "The resource of the valley is water.",
    "Turn the handle and switch the lamp on.",
    "My brother requires new shoes.",
    "This tree needs water.",
    "The error was small.",
    "They expired the air slowly.",
    "Chưa ai đọc bức thư này.",
    "Anh ấy đang chờ bạn ở đây.",
    "Quyền lợi của người dân phải được bảo vệ.",
    "\"Something went wrong\" nghĩa là \"có gì đó không ổn\".",
    "The dictionary entry shows the stress of the word.",
    "This section describes the verbs of motion.",
    "Examples are given below.",
    "The title of the book is missing a letter.",
]


def test_recall_and_precision():
    found = [*RESIDUE_1, *RESIDUE_2, *RESIDUE_3]
    ordinary = [*ORDINARY_1, *ORDINARY_2, *ORDINARY_3]
    missed = [x for x in found if not residue(x)]
    false = [x for x in ordinary if residue(x)]
    assert len(missed) <= 0.1 * len(found) and len(false) <= 0.02 * len(ordinary), (missed, false)


def test_length_changes_nothing():
    clean = "They mend the shallow oven at dawn and weigh the straw. " * 4000
    for x in (*RESIDUE_3, "Dear ${name}, hello."):
        assert bool(residue(x)) == bool(residue(f"{clean}\n\n{x}\n\n{clean}")), x
    assert residue(clean) is None
    assert residue("He said that " + "very old " * 3000 + "words, such as {{name}}, stand for a value.") is None
